"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import id_or_lowest, id_or_null, written
from tracewell.llm.hashing import text_chunks

PIECES = "_d long, start long, length long, ids binary, doc_tokens long, part int, place long"
NAMES = [x.split()[0] for x in PIECES.split(", ")]
#: Rows of the offset table (a length, a task, a number) up to which it is broadcast: about 5 MB.
MOST_OFFSETS = 200_000
#: Units of text whose ids a task remembers (about 40 bytes each), and their longest in bytes.
REMEMBERED, SHORT = 1_500_000, 64
#: UTF-8 bytes of text that are encoded at a time; a longer text comes alone.
CHUNK = 4 << 20
#: Bytes: ASCII letters, stops, visible ASCII, and what a character that is no white space can start with.
LETTER, STOP, SEEN, START = (np.zeros(256, bool) for _ in range(4))
LETTER[65:91] = LETTER[97:123] = True
STOP[[ord(x) for x in ",.;:!?\n"]] = True
SEEN[33:127] = START[33:127] = START[0xC3:0xE0] = True
#: First bytes of the letters U+00C0 to U+027F; two signs among them are none.
LATIN = np.zeros(256, bool)
LATIN[0xC3:0xCA] = True


def units_of(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the units of texts start: at ``first``, and where no token of a byte-level tokenizer goes across: before a space and a visible character, between a letter and a
    stop, between a single newline and a visible character."""
    cut = np.zeros(len(data), bool)
    now, then = data[1:], data[:-1]
    cut[:-1] = (then == 32) & START[now]
    cut[1:] |= LETTER[then] & STOP[now]
    if len(data) > 2:
        two, stop = data[:-2], STOP[data[2:]]
        cut[2:] |= SEEN[two] & (data[1:-1] == 10) & START[data[2:]]
        cut[2:] |= stop & LATIN[two] & (data[1:-1] >= 128) & ~((two == 0xC3) & ((data[1:-1] == 0x97) | (data[1:-1] == 0xB7)))
    cut[first] = True
    return np.flatnonzero(cut)


class Encoder:
    """Token ids by the tokenizer of a file; one for each worker process, as Spark's tasks are the parallelism; what it has learnt is forgotten after a task.

    A byte-level tokenizer's tokens never cross certain places, so it encodes a text as it encodes the units between these, and each unit that texts repeat is encoded once; words new to the task go to the tokenizer together,
    on a line each. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        before = told.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        added = [x for x in told.get("added_tokens", ()) if x["lstrip"] or x["rstrip"] or x["single_word"] or set(x["content"]) & set(" ,.;:!?\n")]
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.units = plain and not told.get("normalizer") and not added and told["model"].get("type") == "BPE" and len(self.newline) == 1
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def lines(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of units, encoded together on a line each."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(units), 20_000):
            text = "\n".join(units[at : at + 20_000].to_pylist())
            found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = found == self.newline[0]
            sizes.append(np.diff(np.append(np.flatnonzero(ends), len(found)), prepend=-1) - 1)
            ids.append(found[~ends])
        return np.concatenate(ids), np.concatenate(sizes)

    def single(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of units, each encoded by itself."""
        found = [np.array(x.ids, np.uint32) for at in range(0, len(units), 5000) for x in self.tokenizer.encode_batch_fast(units[at : at + 5000].to_pylist(), add_special_tokens=False)]
        return np.concatenate([*found, np.zeros(0, np.uint32)]), np.array([len(x) for x in found], np.int64)

    def of(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each unit (all different) among all that is held, and these ones' ends (after a first 0) in the last array, of ids."""
        if len(self.known) > REMEMBERED:
            self.forget()
        which = pc.index_in(units, self.known)
        fresh = pc.is_null(which)
        new = units.filter(fresh)
        # a word, perhaps behind a space: a newline before and after it is always a token of its own
        word = pc.and_(pc.match_substring_regex(new, r"^ ?\pL+$"), pc.less_equal(pc.binary_length(new), SHORT))
        word = word if self.units else pc.and_(word, False)
        short = pc.and_not(pc.less_equal(pc.binary_length(new), SHORT), word)
        kinds = [new.filter(word), new.filter(short), new.filter(pc.and_not(pc.invert(word), short))]
        found = [self.lines(kinds[0]), self.single(kinds[1]), self.single(kinds[2])]
        flat = np.concatenate([self.ids, *[x for x, _ in found]])
        ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.concatenate([x for _, x in found])))
        place, first = np.zeros(len(new), np.int64), len(self.known)
        for held, part in zip((word, short, pc.and_not(pc.invert(word), short)), kinds, strict=True):
            place[held.to_numpy(zero_copy_only=False)] = first + np.arange(len(part))
            first += len(part)
        out = which.fill_null(0).to_numpy().astype(np.int64)
        out[fresh.to_numpy(zero_copy_only=False)] = place
        self.known = pa.concat_arrays([self.known, *kinds[:2]])
        self.ends = ends[: len(self.known) + 1].copy()
        self.ids = flat[: self.ends[-1]].copy()
        return out, ends, flat

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with ``end_id`` after each, and each one's number of ids."""
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        if self.units and len(data):
            first = units_of(data, first)
        bounds = pa.py_buffer(np.append(first, len(data)).astype(np.int64))
        units = pa.Array.from_buffers(pa.large_string(), len(first), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        which = units.indices.to_numpy()
        known, ends, flat = self.of(units.dictionary)
        # the closing id is a unit behind each text's last
        last = np.searchsorted(first, offsets[1:])
        row = np.insert(known[which], last, len(ends) - 1)
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(ends, len(flat) + 1)), pa.array(np.append(flat, np.uint32(end_id))))
        taken = lists.take(pa.array(row))
        until = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][last + np.arange(1, len(last) + 1)]
        return taken.flatten().to_numpy(), np.diff(until, prepend=0)


@functools.cache
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def piece_lengths(tokens: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of the binary decomposition of token counts: as many pieces of ``most`` as fit, then one for each set bit."""
    full, bits = tokens // most, [1 << k for k in range(most.bit_length() - 2, -1, -1)]
    times = np.column_stack([full, *[(tokens % most & bit > 0).astype(np.int64) for bit in bits]])
    doc = np.repeat(np.arange(len(tokens)), times.sum(axis=1))
    return doc, np.repeat(np.tile([most, *bits], len(tokens)), times.ravel())


def pack_documents(docs: DataFrame, tokenizer_path: str, most: int = 1024, end_id: int = 0) -> DataFrame:
    """Cut each document's tokens into pieces of power-of-two length; pieces of equal length are numbered together.

    In: doc_id, text (others are ignored); ``tokenizer_path`` is a file of a byte-level tokenizer. Out: a row per piece with doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens (with the closing ``end_id``), sequence_id
    and offset (always 0: a sequence is one piece). Sequence ids are gapless from 0 and ordered by length, the longest
    first, so a range of ids is a bucket of equally long sequences and a batch needs no padding.

    Null or empty text is ``end_id`` alone. A null doc_id stays null. Repeated rows are packed each by itself. An empty table gives an
    empty table. A very long text is encoded like any other, in units that end where tokens do. Input columns with the result's
    names are ignored like all others.

    Pieces are written once with their place among the pieces of equal length of their task; the offset of a task and
    length is a running sum over their counts. That table has a row per task and length; it is broadcast if it is small,
    so that numbering shuffles no piece, and joined by shuffle beyond that.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        places = np.zeros(most.bit_length(), np.int64)  # pieces so far, by the logarithm of their length
        try:
            for batch in batches:
                docs = batch.column(0).to_numpy()
                for first, _, data, offsets in text_chunks(batch.column(1), CHUNK, 10_000):
                    ids, counts = encoder_of(tokenizer_path)(data, offsets, end_id)
                    doc, length = piece_lengths(counts, most)
                    ends = np.cumsum(length)
                    # pieces follow each other as the ids do, so the ids are the column's bytes as they are
                    bounds = np.append(0, ends * 4).astype(np.int32)
                    held = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
                    kind = np.log2(length).astype(np.int64)
                    place = np.empty(len(doc), np.int64)
                    for k in np.unique(kind):
                        at = np.flatnonzero(kind == k)
                        place[at] = places[k] + np.arange(len(at))
                        places[k] += len(at)
                    start = ends - length - (np.cumsum(counts) - counts)[doc]
                    columns = [pa.array(docs[first + doc]), pa.array(start), pa.array(length), held, pa.array(counts[doc]), pa.array(np.full(len(doc), part, np.int32)), pa.array(place)]
                    yield pa.RecordBatch.from_arrays(columns, NAMES)
        finally:  # Spark keeps the process for later tasks, of other stages too
            encoder_of(tokenizer_path).forget()
            pa.default_memory_pool().release_unused()

    pieces = written(docs.select(id_or_lowest("doc_id").alias("_d"), F.col("text")).mapInArrow(cut, PIECES), "pieces", "zstd")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("_n"))
    # by length first, then over the few lengths, so that no task orders all (length, part) pairs
    inside = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("length").agg(F.sum("_n").alias("_all")).select("length", F.coalesce(F.sum("_all").over(longer), F.lit(0)).alias("_base"))
    offsets = counts.select("length", "part", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_o")).join(F.broadcast(totals), "length")
    offsets = offsets.select("length", "part", (F.col("_o") + F.col("_base")).alias("_o"))
    few = counts.limit(MOST_OFFSETS + 1).count() <= MOST_OFFSETS
    numbered = pieces.join(F.broadcast(offsets) if few else offsets, ["length", "part"])
    return numbered.select(
        id_or_null("_d").alias("doc_id"), "start", "length", "ids", "doc_tokens", (F.col("_o") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

"""Benchmark decontamination as a prefix-filtered set join of benchmark windows against documents."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.llm.common import written
from tracewell.llm.hashing import ALNUM, LOWERED, mix, prefix_hashes, shingle_hashes, span_hashes, text_chunks, words

#: What is added to the documents.
OUT = "n_words long, n_hit long, n_items long, items_sha256 string, items array<long>, spans array<struct<start:int,end:int>>, contaminated boolean"
#: Words of a shingle; shorter windows are shingles of their own length.
SHINGLE = 3


def lowered_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk: rows from and to, bytes, word starts, ends, each text's first word, word hashes."""
    for lo, hi, data, offsets in text_chunks(column):
        data = LOWERED[data]
        starts, ends, first = words(data, offsets, ALNUM)
        yield lo, hi, data, starts, ends, first, mix(span_hashes(prefix_hashes(data), starts, ends))


class Windows:
    """A block of benchmark windows: their words, hashes, items, and shingles."""

    def __init__(self, items: list[tuple[int, str]], size: int) -> None:
        owners: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
        for item, text in items:
            for _, _, data, starts, ends, _, _ in lowered_words(pa.array([text], pa.string())):
                held = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
                for i in range(max(1, len(held) - size + 1) if held else 0):
                    owners[tuple(held[i : i + size])].add(item)
        self.words, self.items = list(owners), [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.hashes = np.zeros((len(self.words), size), np.uint64)
        for i, w in enumerate(self.words):
            joined = pa.array([b" ".join(w).decode("utf-8", "surrogateescape")], pa.string())
            for *_, h in lowered_words(joined):
                self.hashes[i, : len(h)] = h
        #: (shingle, window, offset) of every shingle
        found = []
        for i, n in enumerate(self.lengths):
            k = min(SHINGLE, int(n))
            found += [(int(s), i, at) for at, s in enumerate(shingle_hashes(self.hashes[i, :n], k))]
        self.all = np.array(found, np.uint64).reshape(-1, 3)
        self.sizes = sorted({min(SHINGLE, int(n)) for n in self.lengths})

    def order_by_rarity(self, counts: dict[int, int]) -> None:
        """Keep the prefix of each window: for exact containment that is its one rarest shingle."""
        best: dict[int, tuple[int, int, int]] = {}
        for s, i, at in self.all.tolist():
            key = (counts.get(s, 0), s, at)
            if i not in best or key < best[i]:
                best[i] = key
        kept = sorted((s, i, at) for i, (_, s, at) in best.items())
        self.prefix = np.array([x[0] for x in kept], np.uint64)
        self.window, self.offset = np.array([x[1] for x in kept], np.int64), np.array([x[2] for x in kept], np.int64)


def member(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions in values that are among sorted_keys."""
    if not len(sorted_keys) or not len(values):
        return np.zeros(0, np.int64)
    low = (values >> np.uint64(44)).astype(np.int64)  # a bit table first: most values stop there
    table = np.zeros(1 << 20, bool)
    table[(sorted_keys >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[low])
    at = np.minimum(np.searchsorted(sorted_keys, values[maybe]), len(sorted_keys) - 1)
    return maybe[sorted_keys[at] == values[maybe]]


def rarity(docs: DataFrame, block: Windows) -> dict[int, int]:
    """How often each shingle of the block occurs in all documents; the result is no larger than the block."""
    keys = docs.sparkSession.sparkContext.broadcast((np.unique(block.all[:, 0]), block.sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = keys.value
        totals = np.zeros(len(known), np.int64)
        for batch in batches:
            for *_, hashes in lowered_words(batch.column(0)):
                for k in sizes:
                    shingles = shingle_hashes(hashes, k)
                    hit = shingles[member(known, shingles)]
                    totals += np.bincount(np.searchsorted(known, hit), minlength=len(known))
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(known[at].view(np.int64)), pa.array(totals[at])], ["s", "n"])

    sums = docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    return {row.s % (1 << 64): row.n for row in sums}


def hits(block: Windows, size: int, data, starts, ends, first, hashes) -> Iterator[tuple[int, int, int, int]]:
    """(text of the chunk, window, first word, last word + 1 within the text) of verified occurrences."""
    for k in block.sizes:
        shingles = shingle_hashes(hashes, k)
        at = member(block.prefix, shingles)
        if not len(at):
            continue
        lo, hi = np.searchsorted(block.prefix, shingles[at], "left"), np.searchsorted(block.prefix, shingles[at], "right")
        times = hi - lo
        at, entry = np.repeat(at, times), np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        window = block.window[entry]
        begin = at - block.offset[entry]
        end = begin + block.lengths[window]
        text = np.searchsorted(first, at, "right") - 1
        ok = (begin >= first[text]) & (end <= first[text + 1])  # bounds by position and length
        begin, end, window, text = begin[ok], end[ok], window[ok], text[ok]
        for j in range(size):
            inside = j < block.lengths[window]
            same = ~inside | (hashes[np.minimum(begin + j, len(hashes) - 1)] == block.hashes[window, j])
            begin, end, window, text = begin[same], end[same], window[same], text[same]
        for b, e, w, t in zip(begin.tolist(), end.tolist(), window.tolist(), text.tolist(), strict=True):
            if all(data[starts[b + j] : ends[b + j]].tobytes() == x for j, x in enumerate(block.words[w])):
                yield t, w, b - int(first[t]), e - int(first[t])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def blocks(benchmark: DataFrame, size: int, most: int) -> Iterator[Windows]:
    """The benchmark in blocks of about ``most`` bytes of text; one block is on the driver at a time."""
    held, bytes_held = [], 0
    for row in benchmark.select("item_id", "text").filter("item_id is not null and text is not null").toLocalIterator():
        if held and bytes_held + len(row.text) > most:
            yield Windows(held, size)
            held, bytes_held = [], 0
        held.append((int(row.item_id), row.text))
        bytes_held += len(row.text)
    yield Windows(held, size)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """Find every occurrence of a window of ``size`` words of a benchmark item in the documents.

    In: docs with text, benchmark (item_id, text). Out: docs' rows and columns, and n_words, n_hit (words inside any
    occurrence), n_items and items (items with an occurring window), items_sha256 (of the ids sorted as strings and
    comma-joined), spans (runs of hit words, [start, end)), contaminated. Input columns of these names are left out.

    Words are lower-cased ASCII alphanumerics and characters beyond ASCII. An item of fewer words is one window; one of
    none has no windows. Null or empty text has no words; benchmark rows with a null item_id or text are left out.
    Repeated rows each get a row. With an empty benchmark nothing is hit.

    The benchmark is the query set: it is joined in blocks of about ``block_bytes`` of text, each broadcast (a block's index is
    about 100 times its text at most), so any size of benchmark works, with one pass over the documents for counts and one for the join a block. A
    window's shingles are ordered by rarity in all documents; an exact match must hold the rarest, so only that is looked up.
    """
    if "text" not in docs.columns:
        raise ValueError("docs need a text column")
    docs = docs.drop(*[x.split()[0] for x in OUT.split(", ")])
    names = docs.columns
    state, found = docs, None
    for block in blocks(benchmark, size, block_bytes):
        if found is not None:
            state = written(found, "decontaminate")
        block.order_by_rarity(rarity(docs, block))
        held = docs.sparkSession.sparkContext.broadcast(block)
        text_at, again = names.index("text"), found is not None

        def join(batches: Iterator[pa.RecordBatch], held=held, again=again) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                counts = np.zeros(n, np.int64)
                spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
                items: list[set[int]] = [set() for _ in range(n)]
                if again:
                    for i, (old_spans, old_items) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                        spans[i], items[i] = [(x["start"], x["end"]) for x in old_spans], set(old_items)
                for lo, hi, *chunk in lowered_words(batch.column(text_at)):
                    counts[lo:hi] = np.diff(chunk[3])
                    for t, w, b, e in hits(held.value, size, *chunk):
                        spans[lo + t].append((b, e))
                        items[lo + t].update(held.value.items[w])
                runs = [merged(x) for x in spans]
                hit = [sum(e - s for s, e in x) for x in runs]
                ids = [sorted(x) for x in items]
                digests = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[: len(names)],
                        pa.array(counts),
                        pa.array(hit, pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.array(ids, pa.list_(pa.int64())),
                        pa.array([[{"start": s, "end": e} for s, e in x] for x in runs], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array([x > 0 for x in hit], pa.bool_()),
                    ],
                    [*names, "n_words", "n_hit", "n_items", "items_sha256", "items", "spans", "contaminated"],
                )

        found = state.mapInArrow(join, StructType([*docs.schema, *StructType.fromDDL(OUT)]))
    return found

"""Language-model scoring: a weighted backoff automaton of smoothed n-grams, counted over all training texts.

Texts are kept as blocks of tokens. A block asks for the counts of its own distinct n-grams, gives its own ones, and gets the whole corpus's: hashes and counts travel as sorted
arrays, one for each block and bucket of hashes. So a task holds the part of the automaton that its texts can reach, never all of it. The states of that part are
n-grams, with arcs for the words seen after them and a failure arc to the n-gram without its first word; its texts are walked from left to right, all at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import id_or_lowest, id_or_null, written
from tracewell.llm.hashing import LOWERED, NOT_BLANK, PLACES, mix, prefix_hashes, span_hashes, text_chunks, words

#: Hashes of the tokens before a text and after it.
START, END = mix(np.array([2, 1], np.uint64))
#: Tokens of a block, and of a part of a text that is walked by itself, from the n-gram before it.
BLOCK, PART = 3 << 19, 512
#: n-grams that one task counts, about.
TASK_GRAMS = 4 << 20
BLOCKS = "block long, trained long, vocab binary, tokens binary, parts binary, ids binary, rows binary, held binary"


def planes(x: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second ones and so on, which compresses better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def pack_counts(x: np.ndarray) -> bytes:
    """Counts under 255 as a byte each; larger ones follow in eight."""
    large = x >= 255
    return np.where(large, 255, x).astype(np.uint8).tobytes() + x[large].astype(np.int64).tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, offset=n)
    return out


def token_parts(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the tokens of all parts, parts' lengths, parts' texts). A part begins with the ``order`` - 1 tokens before it, which are START before a text."""
    lower = LOWERED[data]
    starts, ends, bounds = words(lower, offsets, NOT_BLANK)
    hashes = mix(span_hashes(prefix_hashes(lower), starts, ends))
    before, texts = order - 1, len(offsets) - 1
    sizes = np.diff(bounds) + 1 + before
    at = np.cumsum(sizes) - sizes
    stream = np.full(int(sizes.sum()), START)
    stream[at + sizes - 1] = END
    of = np.repeat(np.arange(texts), np.diff(bounds))
    stream[at[of] + before + np.arange(len(hashes)) - bounds[of]] = hashes
    parts = -(-(sizes - before) // PART)
    text = np.repeat(np.arange(texts), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = number * PART
    length = np.minimum(begin + PART + before, sizes[text]) - begin
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return stream[np.repeat(at[text] + begin, length) + inside], length, text


def make_blocks(order: int, block: int):
    """Rows (d, held, t): blocks of tokens. A token is its number in the block's vocabulary, which is ordered by how often it occurs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held_parts: list[tuple[np.ndarray, ...]] = []
        held, number, row = 0, 0, 0

        def flush() -> pa.RecordBatch:
            tokens, length, rows, ids, out = (np.concatenate(x) for x in zip(*held_parts, strict=True))
            vocab, local, times = np.unique(tokens, return_inverse=True, return_counts=True)
            often = np.argsort(-times, kind="stable")
            place = np.empty(len(often), np.int32)
            place[often] = np.arange(len(often))
            trained = int((length - order + 1)[~out].sum())
            parts = [x.tobytes() for x in (length.astype(np.int32), ids, rows, out)]
            columns = [[task << 32 | number], [trained], [vocab[often].tobytes()], [planes(place[local])], *[[x] for x in parts]]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["block", "trained", "vocab", "tokens", "parts", "ids", "rows", "held"])

        for batch in batches:
            ids, out = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_chunks(batch.column(2)):
                tokens, length, text = token_parts(data, offsets, order)
                ends = np.cumsum(length)
                at = 0
                while at < len(length):
                    done = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, done + block, "right")))
                    some = slice(at, to)
                    held_parts.append((tokens[done : ends[to - 1]], length[some], (task << 32) + row + text[some], ids[lo + text[some]], out[lo + text[some]]))
                    held += int(ends[to - 1]) - done
                    at = to
                    if held >= block:
                        yield flush()
                        held_parts.clear()
                        held, number = 0, number + 1
                row += hi - lo
        if held_parts:
            yield flush()

    return run


class Block:
    """A block's tokens, its parts, and its distinct n-grams of each order, in the order of their hashes."""

    def __init__(self, row: dict, order: int) -> None:
        self.order = order
        self.vocab = np.frombuffer(row["vocab"], np.uint64)
        self.tokens = from_planes(row["tokens"], np.int32).astype(np.int64)
        self.length = np.frombuffer(row["parts"], np.int32).astype(np.int64)
        self.ids, self.rows, self.held = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64), np.frombuffer(row["held"], bool)
        self.first = np.cumsum(self.length) - self.length
        self.part = np.repeat(np.arange(len(self.length)), self.length)
        place = np.arange(len(self.tokens)) - self.first[self.part]
        self.own = np.flatnonzero(place >= order - 1)  # the tokens that are scored
        self.grams: list[np.ndarray] = []  # of each order, rows of tokens
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        size = len(self.vocab)
        begins = np.flatnonzero(self.vocab == START)
        for k in range(1, order + 1):
            # those before the scored tokens lead to a state, but are counted where they are scored
            at = np.flatnonzero(place >= k - 1) if k < order else self.own
            code = self.tokens[at]
            for back in range(1, k):
                code = code + self.tokens[at - back] * size**back
            trains = ~self.held[self.part[at]] & (place[at] >= order - 1)
            # what stands before a text is a context of its own, as often as texts begin
            if k < order and len(begins):
                opens = self.first[(self.tokens[self.first] == begins[0]) & self._opens(begins[0])]
                start = int(begins[0]) * sum(size**back for back in range(k))
                code = np.concatenate([code, np.full(len(opens), start)])
                trains = np.concatenate([trains, ~self.held[self.part[opens]]])
            kinds, of = np.unique(code, return_inverse=True)
            times = np.bincount(of, weights=trains, minlength=len(kinds)).astype(np.int64)
            gram = np.stack([kinds // size**back % size for back in range(k - 1, -1, -1)], axis=1)
            key = self.vocab[gram[:, 0]] if k == 1 else mix(sum((self.vocab[gram[:, i]] * PLACES[i] for i in range(k)), np.uint64(k)))
            by = np.argsort(key, kind="stable")
            self.grams.append(gram[by])
            self.keys.append(key[by])
            self.counts.append(times[by])

    def _opens(self, start: int) -> np.ndarray:
        """Parts that begin their text: all tokens before the first own one are START."""
        out = np.ones(len(self.first), bool)
        for i in range(self.order - 1):
            out &= self.tokens[self.first + i] == start
        return out


def bucket_bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket, the keys with the same first bits, begins in sorted keys; one more at the end."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def ask(order: int, bits: int):
    """Blocks: rows (bucket, k, block, keys, counts), the block's n-grams of order k and how often its training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row, order)
                for k, (keys, counts) in enumerate(zip(block.keys, block.counts, strict=True), 1):
                    at = bucket_bounds(keys, bits)
                    some = np.flatnonzero(np.diff(at))
                    columns = [
                        pa.array(some),
                        pa.array(np.full(len(some), k, np.int32)),
                        pa.array(np.full(len(some), row["block"])),
                        pa.array([planes(keys[at[b] : at[b + 1]]) for b in some], pa.binary()),
                        pa.array([pack_counts(counts[at[b] : at[b + 1]]) for b in some], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "k", "block", "keys", "counts"])

    return run


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's whole buckets: rows (bucket, k, block, counts, fresh) with the counts of all blocks; fresh: of the words among them that training texts have, once."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for bucket, k, block, keys, counts in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            own = from_planes(keys, np.uint64)
            held.setdefault(k, []).append((bucket, block, own, unpack_counts(counts, len(own))))
    for k, rows in held.items():
        keys, of = np.unique(np.concatenate([x[2] for x in rows]), return_inverse=True)
        total = np.bincount(of, weights=np.concatenate([x[3] for x in rows])).astype(np.int64)
        fresh = int(((total > 0) & (keys != START)).sum()) if k == 1 else 0
        ends = np.cumsum([len(x[2]) for x in rows])
        for at in range(0, len(rows), 500):
            some = range(at, min(at + 500, len(rows)))
            columns = [
                pa.array([rows[i][0] for i in some], pa.int64()),
                pa.array([k] * len(some), pa.int32()),
                pa.array([rows[i][1] for i in some], pa.int64()),
                pa.array([pack_counts(total[of[ends[i] - len(rows[i][2]) : ends[i]]]) for i in some], pa.binary()),
                pa.array([0 if i else fresh for i in some], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "k", "block", "counts", "fresh"])


class Automaton:
    """States are the root and the n-grams that training texts go on from. An arc leads from a state by a word; a failure arc to the state of the n-gram without its first word."""

    def __init__(self, vocab: int, grams: list[np.ndarray], counts: list[np.ndarray], tokens: int, distinct: int, prior: float) -> None:
        """``grams`` and ``counts`` by order; all words of the vocabulary have an arc from the root.

        p(w) = (count + 1) / (tokens + distinct + 1), and p(w | h) = (count of hw + prior * p(w | h without its first word)) / (count of h + prior).
        """
        self.vocab = vocab
        places = [self._codes(gram) for gram in grams]
        self.words = np.zeros(vocab, np.int64)
        self.words[grams[0][:, 0]] = counts[0]
        self.base = np.log10((self.words + 1) / (tokens + distinct + 1))
        state_of = []  # of each order's n-grams by code: sorted codes, states (0: none)
        known, self.fail, self.fail_weight = 1, [np.zeros(1, np.int64)], [np.zeros(1)]
        last = len(grams)
        for k in range(1, last):
            alive = counts[k - 1] > 0
            state = np.where(alive, np.cumsum(alive) - 1 + known, 0)
            by = np.argsort(places[k - 1])
            state_of.append((places[k - 1][by], state[by]))
            parent = np.zeros(int(alive.sum()), np.int64) if k == 1 else self._find(state_of[k - 2], self._codes(grams[k - 1][alive][:, 1:]))
            self.fail.append(parent)
            self.fail_weight.append(np.log10(prior / (counts[k - 1][alive] + prior)))
            known += int(alive.sum())
        self.fail, self.fail_weight = np.concatenate(self.fail), np.concatenate(self.fail_weight)
        p = (self.words + 1) / (tokens + distinct + 1)
        lower = (np.arange(vocab), p)  # codes and probabilities one order below
        reach = self._find(state_of[0], np.arange(vocab)) if state_of else np.zeros(vocab, np.int64)
        keys, weights, targets = [np.arange(vocab)], [np.log10(p)], [reach]
        for k in range(2, last + 1):
            seen = counts[k - 1] > 0
            gram, times = grams[k - 1][seen], counts[k - 1][seen]
            source = self._find(state_of[k - 2], self._codes(gram[:, :-1]))
            by = np.argsort(places[k - 2])
            context = counts[k - 2][by][np.searchsorted(places[k - 2][by], self._codes(gram[:, :-1]))]
            under = lower[1][np.searchsorted(lower[0], self._codes(gram[:, 1:]))]
            p = (times + prior * under) / (context + prior)
            code = self._codes(gram)
            order = np.argsort(code)
            lower = (code[order], p[order])
            target = self._find(state_of[k - 1], code) if k < last else self._find(state_of[k - 2], self._codes(gram[:, 1:]))
            keys.append(source * vocab + gram[:, -1])
            weights.append(np.log10(p))
            targets.append(target)
        key = np.concatenate(keys)
        order = np.argsort(key)
        self.key, self.weight, self.target = key[order], np.concatenate(weights)[order], np.concatenate(targets)[order]

    def _codes(self, grams: np.ndarray) -> np.ndarray:
        out = grams[:, 0].astype(np.int64)
        for i in range(1, grams.shape[1]):
            out = out * self.vocab + grams[:, i]
        return out

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
        """States of the codes; 0 for unknown ones."""
        at = np.minimum(np.searchsorted(table[0], codes), len(table[0]) - 1)
        return np.where(table[0][at] == codes, table[1][at], 0) if len(table[0]) else np.zeros(len(codes), np.int64)

    def walk(self, tokens: np.ndarray, first: np.ndarray, length: np.ndarray, context: int) -> np.ndarray:
        """The log10 probability of each part, tokens[first : first + length] without its first ``context`` tokens, which only lead to its state.

        Each part carries its state from left to right; a word without an arc takes the failure arc and is tried again.
        """
        out = np.zeros(len(first))
        by = np.argsort(-length, kind="stable")
        begin, ends = first[by], -length[by]
        state, sums = np.zeros(len(by), np.int64), np.zeros(len(by))
        for t in range(int(length.max(initial=0))):
            active = int(np.searchsorted(ends, -t, "left"))
            word = tokens[begin[:active] + t]
            open_ = np.arange(active)
            while len(open_):
                key = state[open_] * self.vocab + word[open_]
                arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                hit = self.key[arc] == key
                there, on = open_[hit], arc[hit]
                if t >= context:
                    sums[there] += self.weight[on]
                state[there] = self.target[on]
                open_ = open_[~hit]
                if t >= context:
                    sums[open_] += self.fail_weight[state[open_]]
                state[open_] = self.fail[state[open_]]
        out[by] = sums
        return out


def score_blocks(order: int, tokens: int, distinct: int, prior: float):
    """Blocks with their answers: rows (row, d, held, n_tokens, n_known, base, score), one for each block and text of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row, order)
                counts = []
                for k, keys in enumerate(block.keys, 1):
                    said = {x["bucket"]: x["counts"] for x in row["answers"] if x["k"] == k}
                    at = bucket_bounds(keys, row["bits"])
                    counts.append(np.concatenate([np.zeros(0, np.int64), *[unpack_counts(said[b], at[b + 1] - at[b]) for b in sorted(said)]]))
                machine = Automaton(len(block.vocab), block.grams, counts, tokens, distinct, prior)
                score = machine.walk(block.tokens, block.first, block.length, order - 1)
                texts, of = np.unique(block.rows, return_inverse=True)
                first = np.unique(of, return_index=True)[1]
                own, said = of[block.part[block.own]], block.tokens[block.own]
                total = lambda x, by=own: np.bincount(by, weights=x, minlength=len(texts))
                columns = [texts, block.ids[first], block.held[first], total(np.ones(len(own))).astype(np.int64), total(machine.words[said] > 0).astype(np.int64), total(machine.base[said]), total(score, of)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "d", "held", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, held_out: str, order: int = 2, prior: float = 100.0, block: int = BLOCK, task_grams: int = TASK_GRAMS) -> DataFrame:
    """The log10 probability of each text by an n-gram model of the texts that are not held out.

    In: doc_id, text, and the boolean column named ``held_out`` (others are ignored). Out: a row per input row with doc_id, held_out, n_tokens, n_known (tokens that training texts
    have), train_tokens (the tokens of all training texts), base_score (by single words, add-one smoothed), score (by the automaton).

    Tokens are lower-cased (A-Z) words between space and U+0009 to U+000D, then one end. Null or empty text is the end alone. A null in ``held_out`` is false. Repeated rows count each, and get equal
    scores. A null doc_id stays null. An empty table gives an empty table. Words and n-grams are told apart by hashes of 64 bits: two n-grams of one hash, which about n * n / 2 ** 65 pairs
    of n different ones are, share a count.

    Shuffled are one hash and one count for each distinct n-gram of a block, twice the counts, and the blocks. A block is of ``block`` tokens, a longer text goes on in the next one; a task that counts
    has about ``task_grams`` hashes. An n-gram that all texts have is one entry for each block.
    """
    spark: SparkSession = docs.sparkSession
    base = docs.select(id_or_lowest("doc_id").alias("d"), F.coalesce(F.col(held_out), F.lit(False)).alias("held"), F.col("text").alias("t"))
    blocks = written(base.mapInArrow(make_blocks(order, block), BLOCKS), "lm-blocks", "zstd")
    sums = blocks.agg(F.sum("trained").alias("n"), F.sum(F.octet_length("tokens") / 4).alias("size")).first()
    trained, size = int(sums.n or 0), int(sums["size"] or 0)
    parts = max(size * order // task_grams + 1, spark.sparkContext.defaultParallelism)
    bits = int(parts * 8 - 1).bit_length()
    asked = blocks.select("block", "vocab", "tokens", "parts", "ids", "rows", "held").mapInArrow(ask(order, bits), "bucket long, k int, block long, keys binary, counts binary")
    answers = asked.repartition(parts, "bucket").mapInArrow(answer, "bucket long, k int, block long, counts binary, fresh long")
    answers = written(answers, "lm-answers", "zstd")
    distinct = int(answers.agg(F.sum("fresh").alias("n")).first().n or 0)
    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "k", "counts")).alias("answers"))
    met = blocks.drop("trained").join(gathered, "block").withColumn("bits", F.lit(bits))
    scored = met.mapInArrow(score_blocks(order, trained, distinct, prior), "row long, d long, held boolean, n_tokens long, n_known long, base_score double, score double")
    whole = scored.groupBy("row", "d", "held").agg(*[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")])
    return whole.withColumnRenamed("d", "_d").select(id_or_null("_d").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"), "base_score", "score")

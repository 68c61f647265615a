"""Suffix-array dedup: remove bytes of strings of a given length that start more than once in the corpus.

The suffixes that can matter are found first. A window (a string of ``length`` bytes) is known by its anchor: the least
of its 50-byte grams, by polynomial hash. Equal windows have equal anchors at equal places, so windows are compared only
within an anchor's gram, and a run of windows that share an anchor travels as one context. A context that equals another
byte for byte settles all its windows at once; one of each kind goes on, into a suffix sort: a mergesort whose comparisons find
the common extension of two suffixes by binary search over prefix hashes, with equal neighbours verified byte by byte.
Hashes only bring candidates together: on every route bytes are compared before any is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import broadcast_if_small, id_or_lowest, id_or_null, written
from tracewell.llm.hashing import BYTE_VALUES, mix, prefix_hashes, span_hashes, text_chunks

GRAM = 50
#: A text longer than this is worked on in overlapping pieces of it.
PIECE = 2 << 20
#: Kinds: a span of repeated bytes (p to c); an anchor; an anchor whose context is known to repeat. HOT is added for grams that many share.
SURE, OPEN, KNOWN, HOT = 0, 1, 2, 10
ANCHORS = "g long, c long, d long, v long, p long, kind int"
#: Anchors that a shuffle partition should hold, and of one gram from which its contexts are compared by shuffles instead of in a task.
PARTITION_ROWS, HOT_ROWS = 250_000, 20_000
#: One in so many texts counts the grams before the shuffle, so that hot ones are dealt over many tasks; longer ones than LONG bytes all do.
SAMPLE, LONG = 64, 256 << 10
#: Representatives' rows that a broadcast may hold, at up to a few hundred bytes each.
MOST_REPS = 50_000
SPANS = "d long, v long, s long, e long"
RUN = ["d", "v", "rd", "rv", "delta", "run"]


def pieces(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place of the bytes in the text): chunks of rows, long texts in pieces that overlap
    by length - 1 bytes."""
    for lo, _, data, offsets in text_chunks(column):
        if len(data) <= PIECE:
            yield lo, data, offsets, 0
        else:
            for at in range(0, max(1, len(data) - length + 1), PIECE):
                part = data[at : at + PIECE + length - 1]
                yield lo, part, np.array([0, len(part)]), at


def window_anchors(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of one text with one anchor: text, first window, windows, anchor, gram hash."""
    width = length - GRAM + 1
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, np.zeros(0, np.uint64)
    at = np.arange(len(data) - GRAM + 1)
    grams = mix(span_hashes(prefix, at, at + GRAM))
    key = (grams & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)  # least hash, then leftmost
    padded = np.full(-(-len(key) // width) * width, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)  # windows that lie in one text
    first, last = offsets[:-1], offsets[1:] - length + 1
    whole = last > first
    np.add.at(inside, first[whole], 1)
    np.add.at(inside, last[whole], -1)
    ok = np.cumsum(inside[:-1]) > 0
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    new[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(ok & new)
    ends = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True)) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    return text, starts, ends - starts, anchor[starts], grams[anchor[starts]]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Whether data[a : a + size] and data[b : b + size] are equal, for each entry."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(size)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        n = size[at:to]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = data[np.repeat(a[at:to], n) + inside] == data[np.repeat(b[at:to], n) + inside]
        out[at:to] = np.logical_and.reduceat(equal, first) if len(equal) else True
        at = to
    return out


def first_of_kind(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each entry the first one with its g and c."""
    order = np.lexsort((c, g))
    new = np.append(True, (g[order][1:] != g[order][:-1]) | (c[order][1:] != c[order][:-1]))[: len(g)]
    out = np.empty(len(g), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def anchor_rows(columns: list[np.ndarray], kind: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(x) for x in columns], pa.array(kind.astype(np.int32))], [*"gcdvp", "kind"])


class Chunk:
    """The anchors of a chunk of texts: each one's text, start of its context, windows, windows before the anchor, bytes, gram and hash of the context;
    ``twins`` are those whose context equals an earlier one's, ``first``, byte for byte."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, bits: int) -> None:
        prefix = prefix_hashes(data)
        self.text, self.start, self.count, anchor, self.gram = window_anchors(data, offsets, prefix, length)
        self.before, self.size = anchor - self.start, self.count - 1 + length
        context = mix(span_hashes(prefix, self.start, self.start + self.size)) ^ mix(self.before.astype(np.uint64) * np.uint64(256) + self.count.astype(np.uint64))
        self.context = context >> np.uint64(64 - bits) if bits else np.zeros(len(context), np.uint64)
        self.first = first_of_kind(self.gram, self.context)
        twins = np.flatnonzero(self.first != np.arange(len(self.first)))
        of = self.first[twins]
        twins = twins[(self.size[of] == self.size[twins]) & (self.before[of] == self.before[twins])]
        self.twins = twins[same_bytes(data, self.start[self.first[twins]], self.start[twins], self.size[twins])]


def anchors_of(length: int, bits: int = 64):
    """Rows (g, c, d, v, p, kind): gram, hash of the context, text, and packed place, windows before the anchor, windows.

    Of contexts that repeat within the chunk one stays, as known to repeat, and the spans of all are sure.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, data, offsets, base in pieces(batch.column(2), length):
                found = Chunk(data, offsets, length, bits)
                text, start = found.text, found.start
                kind = np.full(len(text), OPEN)
                kind[found.first[found.twins]] = KNOWN
                stays = np.ones(len(text), bool)
                stays[found.twins] = False
                shift = base - offsets[text]
                place = (start + shift) << 16 | found.before << 8 | found.count
                columns = [found.gram.view(np.int64), found.context.view(np.int64), ids[lo + text], versions[lo + text], place]
                yield anchor_rows([x[stays] for x in columns], kind[stays])
                if len(found.twins):
                    sure = np.flatnonzero(~stays | (kind == KNOWN))  # in the order of their places
                    s, e = start[sure], np.maximum.accumulate(start[sure] + found.size[sure])
                    head = np.flatnonzero(np.append(True, (s[1:] > e[:-1]) | (text[sure][1:] != text[sure][:-1])))
                    last, at = np.append(head[1:] - 1, len(sure) - 1), sure[head]
                    own, from_ = ids[lo + text[at]], s[head] + shift[at]
                    # dealt by place, as they only pass the next shuffle
                    yield anchor_rows([mix((own + from_).view(np.uint64)).view(np.int64), e[last] + shift[at], own, versions[lo + text[at]], from_], np.full(len(at), SURE))

    return run


def sampled_grams(length: int, sample: int, bits: int):
    """Texts (d, v, t) to rows (g, n): grams of different contexts, a long text's counted once, the others' ``sample`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets, _ in pieces(batch.column(2), length):
                found = Chunk(data, offsets, length, bits)
                stays = np.ones(len(found.text), bool)
                stays[found.twins] = False
                grams, times = np.unique(found.gram[stays], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(times * (1 if len(data) > LONG else sample))], ["g", "n"])

    return run


def settle(hot_rows: int):
    """Of a partition's whole grams: anchors of grams that one text place alone has are done; so are those that are all known.
    Of grams with over ``hot_rows`` anchors and of those flagged hot, all go on as hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            *columns, kind, hot = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            through = np.flatnonzero(hot | (kind == SURE))
            if len(through):
                yield anchor_rows([x[through] for x in columns], np.where(hot, kind + HOT, kind)[through])
            if len(through) < batch.num_rows:
                rest = ~hot & (kind != SURE)
                held.append([*[x[rest] for x in columns], kind[rest]])
        if not held:
            return
        g, *others = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(g, kind="stable")
        g, (c, d, v, p, kind) = g[order], (x[order] for x in others)
        gram = np.cumsum(np.append(True, g[1:] != g[:-1])) - 1
        anchors = np.bincount(gram)[gram]
        some_open = np.bincount(gram, weights=kind == OPEN)[gram] > 0
        kind = np.where(anchors > hot_rows, kind + HOT, kind)
        kept = np.flatnonzero((anchors > 1) & some_open)
        for at in np.array_split(kept, len(kept) // 50_000 + 1):
            yield anchor_rows([x[at] for x in (g, c, d, v, p)], kind[at])

    return run


class Suffixes:
    """Suffixes of concatenated contexts, compared up to ``length`` bytes by hashes of their prefixes."""

    def __init__(self, data: np.ndarray, length: int) -> None:
        self.length, self.data = length, data
        self.prefix = prefix_hashes(data)
        starts = np.arange(len(data) - length + 1)
        self.whole = span_hashes(self.prefix, starts, starts + length)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each suffix a comes before b; false for equal ones."""
        out = np.zeros(len(a), bool)
        differ = np.flatnonzero(self.whole[a] != self.whole[b])
        a, b = a[differ], b[differ]
        same, limit = np.zeros(len(a), np.int64), np.full(len(a), self.length - 1)
        while (open_ := same < limit).any():  # binary search for the longest common extension
            mid = (same + limit + 1) >> 1
            equal = span_hashes(self.prefix, a, a + mid) == span_hashes(self.prefix, b, b + mid)
            same, limit = np.where(open_ & equal, mid, same), np.where(open_ & ~equal, mid - 1, limit)
        out[differ] = self.data[a + same] < self.data[b + same]
        return out

    def sort(self, suffixes: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes by (group, suffix); group must be ascending. A mergesort of all groups at once."""
        n = len(suffixes)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, n))
        base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        local = np.arange(n) - base
        order, run = np.arange(n), 1
        while run < sizes.max(initial=0):
            live = np.flatnonzero(size > run)
            mine = suffixes[order[live]]
            at, where = local[live], base[live]
            left = (at // run) % 2 == 0
            begin = np.where(left, at // run * run + run, at // run * run - run)
            end = np.minimum(begin + run, size[live])
            begin = np.minimum(begin, end)
            lo, hi = begin.copy(), end.copy()
            while (open_ := lo < hi).any():  # rank in the sibling run
                mid = (lo + hi) >> 1
                pick = np.flatnonzero(open_)
                other = suffixes[order[where[pick] + mid[pick]]]
                # equal suffixes keep the left run first
                before = np.zeros(len(pick), bool)
                is_left = left[pick]
                before[is_left] = self.less(other[is_left], mine[pick][is_left])
                before[~is_left] = ~self.less(mine[pick][~is_left], other[~is_left])
                lo[pick], hi[pick] = np.where(before, mid[pick] + 1, lo[pick]), np.where(before, hi[pick], mid[pick])
            rank = lo - begin
            pair = at // (2 * run) * (2 * run)
            target = where + pair + (at - at // run * run) + rank
            merged = order.copy()
            merged[target] = order[live]
            order, run = merged, run * 2
        return order

    def repeated(self, suffixes: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which suffixes share their first ``length`` bytes with another of their group, verified by their bytes."""
        order = self.sort(suffixes, group)
        sorted_, groups = suffixes[order], group[order]
        near = (self.whole[sorted_[1:]] == self.whole[sorted_[:-1]]) & (groups[1:] == groups[:-1])
        out, same, pairs = np.zeros(len(suffixes), bool), near.copy(), np.flatnonzero(near)
        span = np.arange(self.length)
        for at in np.array_split(pairs, len(pairs) // 4_000 + 1):
            same[at] = (self.data[sorted_[at][:, None] + span] == self.data[sorted_[at + 1][:, None] + span]).all(axis=1)
        out[order[:-1][same]] = out[order[1:][same]] = True
        run = np.cumsum(np.append(True, ~near)) - 1
        for k in np.unique(run[:-1][near & ~same]):  # equal hashes of different bytes: the run is grouped by its bytes
            at = np.flatnonzero(run == k)
            rows = np.ascontiguousarray(self.data[sorted_[at][:, None] + span]).view(f"V{self.length}").ravel()
            _, kind, times = np.unique(rows, return_inverse=True, return_counts=True)
            out[order[at]] = times[kind] > 1
        return out


def window_table(g: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts with packed places: the context of each window, its number in it, and its place before the anchor."""
    count, before = p & 255, p >> 8 & 255
    row = np.repeat(np.arange(len(g)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, k, before[row] - k


def spans_of(found: np.ndarray, row: np.ndarray, k: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of found windows as (context, first byte in it, last byte + 1)."""
    at = np.flatnonzero(found)
    new = np.append(True, (row[at][1:] != row[at][:-1]) | (k[at][1:] != k[at][:-1] + 1))[: len(at)]
    last = np.append(new[1:], True)[: len(at)]
    return row[at][new], k[at][new], k[at][last] + length


def suffix_sort(length: int, windows: int = 200_000):
    """Rows (g, c, d, v, p, kind, context) sorted by g and c in whole grams: rows (d, v, s, e) of repeated bytes.

    A context that equals the first of its hash is repeated as a whole, and so is that one; the others are sorted by their windows."""

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        g, c, p, known = frame["g"].to_numpy(), frame["c"].to_numpy(), frame["p"].to_numpy(), frame["kind"].to_numpy() == KNOWN
        sizes = frame["context"].map(len).to_numpy()
        data = np.frombuffer(b"".join(frame["context"]), np.uint8)
        starts = np.cumsum(sizes) - sizes
        new = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        twin = ~new & (p & 0xFFFF == p[first] & 0xFFFF)
        at = np.flatnonzero(twin)
        twin[at] = same_bytes(data, starts[first[at]], starts[at], sizes[at])
        whole = twin.copy()
        whole[first[twin]] = True
        known |= whole
        # one of each kind is compared by windows, in grams with several of which one is not yet known to repeat
        gram = np.cumsum(np.append(True, g[1:] != g[:-1])) - 1
        some = (np.bincount(gram, weights=~twin)[gram] > 1) & (np.bincount(gram, weights=~twin & ~known)[gram] > 0)
        kept = np.flatnonzero(~twin & some)
        row, k, before = window_table(gram[kept], p[kept])
        row = kept[row]
        suffix = starts[row] + k
        group = gram[row] * 256 + before  # equal windows have their anchor at one place
        order = np.argsort(group, kind="stable")
        if len(order):  # a group of one has nothing to compare
            order = order[np.bincount(group)[group[order]] > 1]
        found = np.zeros(len(row), bool)
        if len(order):
            found[order] = Suffixes(data, length).repeated(suffix[order], group[order])
        at, s, e = spans_of(found & ~known[row], row, k, length)
        sure = np.flatnonzero(whole)
        at, s, e = np.concatenate([at, sure]), np.concatenate([s, np.zeros(len(sure), np.int64)]), np.concatenate([e, sizes[sure]])
        place = p[at] >> 16
        return pd.DataFrame({"d": frame["d"].to_numpy()[at], "v": frame["v"].to_numpy()[at], "s": place + s, "e": place + e})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(int((x["p"] & 255).sum()) for x in held) > windows:
                whole = pd.concat(held, ignore_index=True)
                done = whole["g"] != whole["g"].iloc[-1]
                if done.any():
                    yield block(whole[done].reset_index(drop=True))
                held = [whole[~done]]
        if held and sum(map(len, held)):
            yield block(pd.concat(held, ignore_index=True))

    return run


def hash_windows(length: int, bits: int = 64):
    """Rows (g, d, v, p, kind, context): a row (h1, h2, d, v, s, e) for every window."""
    cut = np.uint64(64 - bits)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 2000):
                part = frame.iloc[at : at + 2000]
                sizes = part["context"].map(len).to_numpy()
                data = np.frombuffer(b"".join(part["context"]), np.uint8)
                g, p = part["g"].to_numpy(), part["p"].to_numpy()
                row, k, before = window_table(g, p)
                suffix = (np.cumsum(sizes) - sizes)[row] + k
                one = mix(span_hashes(prefix_hashes(data), suffix, suffix + length))
                two = mix(span_hashes(prefix_hashes(data, BYTE_VALUES), suffix, suffix + length))
                one, two = (x >> cut if bits else np.zeros(len(x), np.uint64) for x in (one, two))
                s = (p[row] >> 16) + k
                yield pd.DataFrame(
                    {
                        "k1": one.view(np.int64),
                        "k2": (two ^ mix(g[row].view(np.uint64) + before.astype(np.uint64))).view(np.int64),
                        "d": part["d"].to_numpy()[row],
                        "v": part["v"].to_numpy()[row],
                        "s": s,
                        "e": s + length,
                    }
                )

    return run


def equal_spans(spans: DataFrame, texts: DataFrame, each: bool = False) -> DataFrame:
    """Rows (k1, k2, d, v, s, e), spans of one length under a key: the (d, v, s, e) of those that equal another span of their key byte for byte,
    each of them or the runs that they cover.

    A key's spans are held against its first one. Neighbouring spans whose first ones are neighbours too are compared as one. What is
    not equal, if hashes collide, goes round again without its first one. A key may hold any share of all rows: the first ones are written, so Spark
    broadcasts them or splits the key.
    """
    found, merge = None, True
    rows = written(spans, "suffix-spans")
    while True:
        least = F.min(F.struct("d", "v", "s", "e"))
        firsts = rows.groupBy("k1", "k2").agg(least.alias("r"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        firsts = written(firsts.select("k1", "k2", *[F.col(f"r.{x}").alias(f"r{x}") for x in "dvse"]), "suffix-first")
        pairs = rows.join(broadcast_if_small(firsts, MOST_REPS), ["k1", "k2"]).filter("not (d = rd and v = rv and s = rs)")
        of = Window.partitionBy("d", "v", "rd", "rv", F.col("s") - F.col("rs")).orderBy("s")
        fresh = (F.col("s") > F.coalesce(F.lag("e").over(of), F.lit(-1))) if merge else F.lit(True)
        runs = pairs.withColumn("_new", fresh.cast("int")).withColumn("run", F.sum("_new").over(of.rowsBetween(Window.unboundedPreceding, 0)))
        runs = written(runs.drop("_new"), "suffix-pairs")
        whole = runs.withColumn("delta", F.col("s") - F.col("rs")).groupBy(*RUN).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("rs").alias("rs"))
        at = lambda name, s: F.substring(F.col(name), (s + 1).cast("int"), (F.col("e") - F.col("s")).cast("int"))
        firsts_at = whole.select("rd", "rv", "rs", (F.col("e") - F.col("s")).alias("n")).distinct()
        own = texts.select(F.col("_d").alias("rd"), F.col("_v").alias("rv"), F.col("_t").cast("binary").alias("_r"))
        own = own.join(broadcast_if_small(written(firsts_at, "suffix-wanted"), MOST_REPS), ["rd", "rv"])
        own = written(own.select("rd", "rv", "rs", "n", F.substring("_r", (F.col("rs") + 1).cast("int"), F.col("n").cast("int")).alias("_r")), "suffix-bytes")
        held = texts.select(F.col("_d").alias("d"), F.col("_v").alias("v"), F.col("_t").cast("binary").alias("_b"))
        said = whole.join(held, ["d", "v"]).withColumn("_b", at("_b", F.col("s"))).withColumn("n", F.col("e") - F.col("s"))
        judged = said.join(own, ["rd", "rv", "rs", "n"]).select("d", "v", "s", "e", "rd", "rv", "rs", "n", "delta", "run", (F.col("_b") == F.col("_r")).alias("same"))
        judged = written(judged, "suffix-judged")
        equal = judged.filter("same")
        if each:
            equal = runs.withColumns({"delta": F.col("s") - F.col("rs"), "n": F.col("e") - F.col("s")}).join(equal.select(*RUN), RUN)
        sure = equal.select("d", "v", "s", "e").unionByName(equal.select(F.col("rd").alias("d"), F.col("rv").alias("v"), F.col("rs").alias("s"), (F.col("rs") + F.col("n")).alias("e")).distinct())
        found = sure if found is None else found.unionByName(sure)
        wrong = judged.filter("not same")
        if wrong.isEmpty():
            return found
        # a run that differs says nothing of its spans: they are held singly against the same first ones, then without these
        again = runs.withColumn("delta", F.col("s") - F.col("rs")).join(wrong.select(*RUN), RUN)
        rest = again.select("k1", "k2", "d", "v", "s", "e")
        if merge:
            rest = rest.unionByName(again.select("k1", "k2", F.col("rd").alias("d"), F.col("rv").alias("v"), F.col("rs").alias("s"), F.col("re").alias("e")).distinct())
        rows, merge = written(rest, "suffix-spans"), False


def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_d, _v, _t, spans): kept bytes and counts."""
    for batch in batches:
        kept, before, removed, runs = [], [], [], []
        for text, spans in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes()
            out, at, gone, n, end = [], 0, 0, 0, -1
            for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                if s > end:
                    out.append(data[at:s])
                    n += 1
                    gone += e - s
                    end = at = e
                elif e > end:
                    gone += e - end
                    end = at = e
            out.append(data[at:])
            kept.append(b"".join(out))
            before.append(len(data))
            removed.append(gone)
            runs.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["d", "n_bytes", "n_removed", "n_spans", "kept"])


def drop_repeats(docs: DataFrame, length: int = 200, hot_rows: int = HOT_ROWS, sample: int = SAMPLE, bits: int = 64) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts elsewhere in the corpus, the same text included.

    In: doc_id, text (others are ignored). Out: a row per input row with doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs) and kept, the bytes that stay (binary: a cut may fall inside a character).

    Texts are their UTF-8 bytes, null is empty; matches don't cross texts, overlaps count, and all strings are judged on the input. Repeated
    rows are copies of each other and lose all that is long enough. Texts shorter than ``length`` stay. A null doc_id stays
    null. An empty table gives an empty table.

    One row per about 76 bytes is shuffled (an anchor), then the contexts that share a gram, with their bytes, and texts twice. Repeats within a
    chunk of text are found where they are read, so a text of one letter is a few rows. A gram in over ``hot_rows`` anchors would fill a task: its contexts, and
    what is left of their windows, are grouped by Spark on 128-bit hashes and held against the first of their group byte by byte. A sample of one in ``sample`` texts,
    and all long ones, only decides which grams are dealt over many tasks before the shuffle; the counts after it are exact, and either route gives the same result.
    ``bits`` of the hashes of contexts and windows are used; fewer only show that unequal bytes stay.
    """
    if not GRAM < length <= 250:
        raise ValueError(f"length must be over {GRAM} and at most 250")
    base = docs.select(id_or_lowest("doc_id").alias("_d"), F.coalesce("text", F.lit("")).alias("_t")).withColumn("_v", F.xxhash64("_t"))
    base = base.select("_d", "_v", "_t")
    rows = written(base.select("_d", "_v", F.octet_length("_t").alias("n")), "suffix-rows")
    size = rows.agg(F.sum("n")).first()[0] or 0
    twice = written(rows.groupBy("_d", "_v").agg(F.count(F.lit(1)).alias("k"), F.max("n").cast("long").alias("n")).filter("k > 1"), "suffix-twice")
    once, sure = base, None
    if not twice.isEmpty():  # repeated rows are repeats as a whole, and one of them stands for all
        keys = broadcast_if_small(twice.select("_d", "_v"), 1_000_000)
        one = base.join(keys, ["_d", "_v"], "left_semi").groupBy("_d", "_v").agg(F.first("_t").alias("_t"))
        once = base.join(keys, ["_d", "_v"], "left_anti").unionByName(one)
        sure = twice.filter(F.col("n") >= length).select(F.col("_d").alias("d"), F.col("_v").alias("v"), F.lit(0).cast("long").alias("s"), F.col("n").alias("e"))
    anchors = once.mapInArrow(anchors_of(length, bits), ANCHORS)
    parts = max(int(size) // (76 * PARTITION_ROWS) + 1, docs.sparkSession.sparkContext.defaultParallelism)
    some = once.filter((F.octet_length("_t") > LONG) | (F.pmod(F.xxhash64("_d", "_v"), F.lit(sample)) == 0))
    counted = some.mapInArrow(sampled_grams(length, sample, bits), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    hot_grams = written(counted.filter(F.col("n") >= hot_rows).select("g"), "suffix-hot")
    flagged = anchors.withColumn("hot", F.lit(False))
    if not hot_grams.isEmpty():
        few = broadcast_if_small(hot_grams.withColumn("hot", F.lit(True)), MOST_REPS)
        flagged = anchors.join(few, "g", "left").select(*"gcdvp", "kind", (F.col("hot").isNotNull() & (F.col("kind") != SURE)).alias("hot"))
    dealt = flagged.repartition(parts, "g", F.when(F.col("hot"), F.pmod(F.xxhash64("d", "p"), F.lit(1024))).otherwise(0))
    settled = written(dealt.mapInArrow(settle(hot_rows), ANCHORS), "suffix-settled")
    count, place = F.col("p").bitwiseAND(255), F.shiftright("p", 16)
    context = F.substring(F.col("_t").cast("binary"), (place + 1).cast("int"), (count - 1 + length).cast("int"))
    named = once.withColumnRenamed("_d", "d").withColumnRenamed("_v", "v")
    cold = settled.filter(F.col("kind").isin(OPEN, KNOWN)).join(named, ["d", "v"]).select(*"gcdvp", "kind", context.alias("context"))
    found = cold.repartition(parts, "g").sortWithinPartitions("g", "c").mapInPandas(suffix_sort(length), SPANS)
    found = found.unionByName(settled.filter(F.col("kind") == SURE).select("d", "v", F.col("p").alias("s"), F.col("c").alias("e")))
    found = found.unionByName(sure) if sure is not None else found
    hot = settled.filter(F.col("kind") > HOT)
    if not hot.isEmpty():
        whole = hot.select(F.col("g").alias("k1"), F.xxhash64("c", F.col("p").bitwiseAND(0xFFFF)).alias("k2"), "d", "v", place.alias("s"), (place + count - 1 + length).alias("e"))
        equal = written(equal_spans(whole, once, each=True), "suffix-equal")
        # one of each kind of context goes on by its windows: the first one, and what equals none
        spans = hot.withColumn("s", place).withColumn("e", place + count - 1 + length)
        first = spans.groupBy("g", "c", F.col("p").bitwiseAND(0xFFFF).alias("w")).agg(F.min(F.struct("d", "v", "p")).alias("r")).select("g", "c", "r.*")
        alone = spans.join(equal, ["d", "v", "s", "e"], "left_anti").select("g", "c", "d", "v", "p")
        kinds = written(first.unionByName(alone).distinct(), "suffix-kinds")
        contexts = kinds.join(named, ["d", "v"]).select("g", "d", "v", "p", context.alias("context"))
        windows = contexts.mapInPandas(hash_windows(length, bits), "k1 long, k2 long, d long, v long, s long, e long")
        found = found.unionByName(equal).unionByName(equal_spans(windows, once))
    spans = written(found.groupBy("d", "v").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "suffix-found")
    joined = base.join(spans, (F.col("d") == F.col("_d")) & (F.col("v") == F.col("_v")), "left").select("_d", "_v", F.col("_t").cast("binary").alias("_t"), "spans")
    return joined.mapInArrow(cut_spans, "d long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("d", "_d").select(
        id_or_null("_d").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept"
    )

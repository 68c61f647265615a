"""Periodic run detection: stretches of words that repeat with a period, found by uniting a text's suffixes by decreasing common prefix.

Suffixes of the texts that hold some repeated words are sorted by prefix doubling. Edges between neighbours are taken in decreasing order of the prefix that they have in
common, as Kruskal's algorithm does; a union-find keeps each class's positions in order. Two positions that become neighbours in their class at a distance
within that prefix seed a run: no position between them has as much in common, so the distance is the smallest period.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import id_or_lowest, id_or_null
from tracewell.llm.hashing import NOT_BLANK, mix, shingle_hashes, text_chunks, words

#: Positions in a block of an ordered set.
BLOCK = 1024
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Ordered:
    """Positions in order, in blocks of bounded size, so that one more never moves all others."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, first: int) -> None:
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def add(self, at: int) -> tuple[int, int]:
        """Put a position in; the ones before and after it (-1: none)."""
        heads, blocks = self.heads, self.blocks
        k = max(bisect_right(heads, at) - 1, 0)
        block = blocks[k]
        i = bisect_left(block, at)
        before = block[i - 1] if i else -1
        after = block[i] if i < len(block) else heads[k + 1] if k + 1 < len(heads) else -1
        block.insert(i, at)
        if not i:
            heads[k] = at
        if len(block) > BLOCK:
            half = len(block) // 2
            blocks.insert(k + 1, block[half:])
            heads.insert(k + 1, block[half])
            del block[half:]
        self.size += 1
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def least_prefix(min_length: int, min_exponent: int) -> int:
    """The fewest words that a run's first two periods have in common from their starts on."""
    return min(max(min_length - d, (min_exponent - 1) * d, 1) for d in range(1, max(min_length, 1) + 1))


def suffix_order(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of (text, suffix of it in words), and each position's place there. A suffix that ends comes before one that goes on.

    Doubling after Larsson and Sadakane: only positions that still share their rank are sorted again.
    """
    n = len(ids)
    first = text * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(first, kind="stable")
    at = np.empty(n, np.int64)
    key, here, span = first[order], np.arange(n), 1
    rank = np.empty(n, np.int64)
    while True:
        # here: the places that order's entries, sorted by key, take
        new = np.append(True, key[1:] != key[:-1])
        group = here[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        rank[order] = group
        single = new & np.append(new[1:], True)
        at[here] = order
        order, here, group = order[~single], here[~single], group[~single]
        if not len(order):
            return at, rank
        ahead = np.full(len(order), -1)
        on = np.flatnonzero(order + span < n)
        on = on[text[order[on] + span] == text[order[on]]]
        ahead[on] = rank[order[on] + span]
        key = group * (n + 1) + ahead + 1
        sub = np.argsort(key, kind="stable")
        order, key = order[sub], key[sub]
        span *= 2


def common_prefixes(ids: list[int], ends: list[int], order: list[int], rank: list[int], text: list[int]) -> list[int]:
    """For each place but the first the words that its suffix has in common with the one before it, of its text; in the order of positions (Kasai)."""
    out, n, h, now = [0] * len(ids), len(ids), 0, -1
    for i in range(n):
        if text[i] != now:
            now, h = text[i], 0
        r = rank[i]
        j = order[r - 1] if r else -1
        if j < 0 or text[j] != now:
            h = 0
            continue
        end = ends[now] - max(i, j)
        while h < end and ids[i + h] == ids[j + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out


def descending_runs(ids: list[int], first: list[int], order: list[int], prefixes: np.ndarray, least: int, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of all texts, by Kruskal's order over the edges between neighbouring suffixes; ``first`` is each position's first one of its text."""
    edges = np.flatnonzero(prefixes >= least)
    edges = edges[np.argsort(-prefixes[edges], kind="stable")]
    held = prefixes[edges].tolist()
    parent: dict[int, int] = {}
    sets: dict[int, Ordered] = {}
    found: list[tuple[int, int, int]] = []

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    def seed(i: int, j: int, common: int) -> None:
        period = j - i
        length = period + common
        # the words before differ, or the run would start earlier
        if length >= min_exponent * period and length >= min_length and (i == first[i] or ids[i - 1] != ids[j - 1]):
            found.append((i, length, period))

    for edge, common in zip(edges.tolist(), held, strict=True):
        a, b = root(edge - 1), root(edge)
        large = sets.get(a) or sets.setdefault(a, Ordered(order[a]))
        small = sets.get(b) or Ordered(order[b])
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        parent[b] = a
        sets.pop(b, None)
        sets[a] = large
        joining = list(small)
        for k, at in enumerate(joining):
            before, after = large.add(at)
            if before >= 0 and (not k or before != joining[k - 1]):
                seed(before, at, common)
            if after >= 0 and (k + 1 == len(joining) or joining[k + 1] > after):
                seed(at, after, common)
    return found


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the words, equal for equal ones."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    solid = np.ascontiguousarray(data[NOT_BLANK[data]])
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(solid)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def chunk_runs(ids: np.ndarray, bounds: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, ...]:
    """Of texts whose words are ids[bounds[k] : bounds[k + 1]]: text, start in it, length, period of each run, in that order."""
    least = least_prefix(min_length, min_exponent)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    none = (np.zeros(0, np.int64),) * 4
    grams = shingle_hashes(mix(ids.astype(np.uint64)), least)
    inside = text[: len(grams)] == text[least - 1 :] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    key = np.sort(mix(grams[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    if not (key[1:] == key[:-1]).any():
        return none
    # texts in which no words come twice in a row of ``least`` have no runs
    key = mix(grams[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    twice = np.flatnonzero(key[order][1:] == key[order][:-1])
    some = np.zeros(len(bounds) - 1, bool)
    some[text[at[order[twice]]]] = True
    kept = np.flatnonzero(some[text])
    own, base = ids[kept], text[kept]
    place, rank = suffix_order(own, base)
    ends = np.cumsum(np.bincount(base, minlength=len(bounds) - 1))
    first = (ends - np.bincount(base, minlength=len(bounds) - 1))[base]
    said, order_ = own.tolist(), place.tolist()
    prefixes = np.array(common_prefixes(said, ends.tolist(), order_, rank.tolist(), base.tolist()))
    found = descending_runs(said, first.tolist(), order_, prefixes, least, min_length, min_exponent)
    if not found:
        return none
    start, length, period = np.array(found, np.int64).T
    start, of = start - first[start], base[start]
    by = np.lexsort((period, start, of))
    return of[by], start[by], length[by], period[by]


def collapsed_texts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts' words that stay, joined by one space."""
    kept = np.flatnonzero(~gone)
    of = np.searchsorted(bounds, kept, "right") - 1
    size = ends[kept] - starts[kept]
    last = np.append(of[1:] != of[:-1], True)[: len(kept)]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[kept]] += 1
    np.subtract.at(edge, ends[kept], 1)
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    solid = data[inside]
    out = np.full(len(solid) + len(kept) - int(last.sum()), 32, np.uint8)
    step = size + ~last
    to = np.cumsum(step) - step
    where = np.arange(len(solid)) + np.repeat(to - (np.cumsum(size) - size), size)
    out[where] = solid
    lengths = np.bincount(of, weights=step, minlength=len(offsets) - 1).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(lengths)])


def run_rows(min_length: int, min_exponent: int):
    """Rows (d, t): rows (d, n_words, runs as three arrays, collapsed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                starts, ends, bounds = words(data, offsets, NOT_BLANK)
                ids = word_ids(data, starts, ends)
                of, start, length, period = chunk_runs(ids, bounds, min_length, min_exponent)
                edge = np.zeros(len(ids) + 1, np.int64)
                np.add.at(edge, bounds[of] + start + period, 1)
                np.subtract.at(edge, bounds[of] + start + length, 1)
                gone = np.cumsum(edge[:-1]) > 0
                out, at = collapsed_texts(data, offsets, starts, ends, bounds, gone)
                counts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=hi - lo))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(counts), pa.array(x)) for x in (start, length, period)]
                collapsed = pa.Array.from_buffers(pa.large_utf8(), hi - lo, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), *lists, collapsed], ["d", "n_words", "s", "l", "p", "collapsed"])

    return run


def find_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """Runs of words: stretches of at least ``min_length`` words and ``min_exponent`` times their smallest period that no neighbouring word extends.

    In: doc_id, text (others are ignored). Out: a row per input row with doc_id, n_words, runs (start in words, length, period; by start, then period) and collapsed: the
    words without those that a run holds after its first period, joined by one space.

    Words are what space and U+0009 to U+000D leave. Null or empty text has none and collapses to an empty text. Runs don't cross texts. Repeated rows get equal results.
    A null doc_id stays null. An empty table gives an empty table. No shuffle: a text is worked on where it is read, in some 200 bytes of memory a word.
    """
    if min_length < 2 or min_exponent < 2:
        raise ValueError("runs have at least two words and two periods")
    base = docs.select(id_or_lowest("doc_id").alias("d"), F.col("text").alias("t"))
    rows = base.mapInArrow(run_rows(min_length, min_exponent), "d long, n_words long, s array<long>, l array<long>, p array<long>, collapsed string")
    runs = F.transform(F.arrays_zip("s", "l", "p"), lambda r: F.struct(r["s"].alias("start"), r["l"].alias("length"), r["p"].alias("period")))
    return rows.withColumnRenamed("d", "_d").select(id_or_null("_d").alias("doc_id"), "n_words", runs.cast(RUNS).alias("runs"), "collapsed")


def greatest_run(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first; null without runs."""
    none = F.lit(None).cast(RUNS[6:-1])
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))

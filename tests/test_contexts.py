"""Overlaps of sources and expansion with limits, on small tables."""

from __future__ import annotations

import random

from tracewell.functions.overlaps import suffix_prefix
from tracewell.operators import expansion, overlap


def longest(left: str, right: str) -> int:
    return next((k for k in range(min(len(left), len(right)), 3, -1) if left[-k:] == right[:k]), 0)


def test_suffix_prefix_against_every_size():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choices("abé😀"[: rng.randint(1, 4)], k=rng.randint(0, 25))) for _ in range(2))
        assert suffix_prefix(a, b) == longest(a, b), (a, b)
    same = "x" * 50_000
    assert suffix_prefix("a" + same, same + "b") == 50_000


SOURCES = "context_id long, document_id long, source_id string, ordinal long, start_line long, end_line long, content string, pairs int"


def trimmed(spark, rows):
    found = overlap.trim_overlaps(spark.createDataFrame([(*r, 0) for r in rows], SOURCES))
    return {(r.context_id, r.source_id): r for r in found.collect()}


def test_trimming(spark):
    rows = [
        (1, 7, "a", 0, 1, 3, "one two three four"),
        (1, 7, "b", 1, 3, 5, "three four five"),
        (1, 7, "c", 2, 6, 8, "five six"),  # starts on the next line, repeats b's end
        (1, 7, "d", 3, 20, 21, "five six"),  # no neighbour
        (1, 8, "e", 0, 1, 2, "three four"),  # another document
        (2, 7, "f", 0, 3, 5, "three four five"),  # another context
        (1, 9, "g", 0, None, 4, "same text"),
        (1, 9, "h", 1, 2, 4, "same text"),
        (1, 10, "i", 0, 1, 9, "inner text is here"),
        (1, 10, "j", 1, 2, 5, "here and there"),  # ends before i does
        (1, 11, "k", 0, 1, 2, "all of it"),
        (1, 11, "l", 1, 2, 2, "of it"),  # nothing would be left
        (None, None, "m", 0, 1, 2, None),
        (None, None, "n", 1, 2, 3, "ñandú ñandú"),
    ]
    found = trimmed(spark, rows)
    assert {k[1]: r.content for k, r in found.items() if r.trimmed_chars} == {"b": " five", "c": " six"}
    assert (found[1, "b"].trimmed_chars, found[1, "b"].trimmed_from, found[1, "c"].trimmed_from) == (10, "a", "b")
    assert found[None, "m"].content == "" and len(found) == len(rows)
    report = {r.context_id: r for r in overlap.overlap_report(overlap.trim_overlaps(spark.createDataFrame([(*r, 0) for r in rows], SOURCES))).collect()}
    assert (report[1].pairs, report[1].overlap_chars, report[1].overlap_bytes, report[1].overlap_tokens, report[2].pairs) == (2, 14, 14, 4, 0)
    assert overlap.trim_overlaps(spark.createDataFrame([], SOURCES)).collect() == []


def test_pieces_put_together_are_the_text(spark):
    rng = random.Random(2)
    texts = ["\n".join(f"line {i} {rng.random()}" for i in range(n)) for n in (1, 7, 8, 9, 40, 41)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    pieces = overlap.line_pieces(docs, 8, 6).withColumnRenamed("document_id", "d").selectExpr("d as context_id", "d as document_id", "ordinal as source_id", "ordinal", "start_line", "end_line", "content")
    parts = sorted((r.document_id, r.ordinal, r.content) for r in overlap.trim_overlaps(pieces).collect())
    assert {d: "".join(c for e, _, c in parts if e == d) for d, _, _ in parts} == {i: t or "" for i, t in enumerate(texts)}


def graph(spark, edges, dead=()):
    rows = [(s, t, f"{s}{t or '?'}", "calls", "resolved" if t else "unresolved", "high", "active", str(t)) for s, t in edges]
    names = {x for e in edges for x in e if x}
    symbols = spark.createDataFrame([(x, "oracle", "d", "stale" if x in dead else "active") for x in names], "symbol_id string, technology string, domain string, status string")
    return spark.createDataFrame(rows, "source string, target string, relation_id string, relation_type string, resolution_status string, confidence string, status string, target_key string"), symbols


def tried(spark, edges, seeds, dead=(), **limits):
    e, s = graph(spark, edges, dead)
    frame = spark.createDataFrame([(1, f"s{i}", node, 1.0 - i / 10) for i, node in enumerate(seeds)], "query_id long, seed_id string, node string, score double")
    return sorted((r.seed_rank, r.depth, r.place, r.source or "", r.target or "", r.status) for r in expansion.expand_levels(e, s, frame, **limits).collect())


def test_expansion_statuses(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "a"), ("b", "d"), ("c", "d"), ("c", None), ("d", "z")]
    found = tried(spark, edges, ["a", "c", None, "d"], dead={"z"}, most_depth=3, most_seeds=3, most_neighbours=20, most_candidates=20)
    by = {(k, s, t): status for k, _, _, s, t, status in found}
    assert by[1, "a", "b"] == by[1, "a", "c"] == by[1, "b", "d"] == "accepted"
    assert (by[1, "b", "a"], by[1, "c", "d"], by[1, "c", ""], by[1, "d", "z"]) == ("cycle", "duplicate", "unresolved_source", "unresolved_source")
    assert (by[2, "c", "d"], by[3, "", ""], by[4, "", "d"]) == ("duplicate", "unresolved_source", "limit")


def test_expansion_limits_hold_over_levels_and_seeds(spark):
    edges = [("a", x) for x in "bcd"] + [("b", x) for x in "efg"] + [("c", "h"), ("d", "i")]
    found = tried(spark, edges, ["a"], most_depth=2, most_seeds=1, most_neighbours=5, most_candidates=20)
    # three relations of a, two of b; b's third, c's and d's first are the limits
    assert [x[-1] for x in found] == ["accepted"] * 5 + ["limit"] * 3
    found = tried(spark, edges, ["a", "b"], most_depth=2, most_seeds=2, most_neighbours=50, most_candidates=4)
    assert [x[-1] for x in found] == ["accepted"] * 4 + ["limit"]  # and the second seed is not tried


def test_chunks_of_an_expansion(spark):
    e, s = graph(spark, [("a", "b"), ("b", "c")])
    seeds = spark.createDataFrame([(1, "s", "a", 0.5), (1, "t", "b", 0.4)], "query_id long, seed_id string, node string, score double")
    traces = expansion.expand_levels(e, s, seeds, 2, 2, 5, 5)
    chunks = spark.createDataFrame([("b", 10), ("c", 11)], "symbol_id string, chunk_id long")
    found = {r.symbol_id: (r.chunk_id, round(r.score, 6), r.seeds) for r in expansion.resolved_chunks(traces, seeds, chunks).collect()}
    assert found == {"b": (10, 0.475, ["s"]), "c": (11, round(0.5 * 0.95**2, 6), ["s", "t"])}

"""jaccard_components against brute force over all pairs."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from tracewell.llm import jaccard_join
from tracewell.llm.hashing import shingle_hashes
from tracewell.llm.jaccard_join import Linked, Sets, jaccard_components, join_region


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {d: (len(x), find(d)) for d, x in sets}


def corpus() -> list[tuple[int, str | None]]:
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    texts: list[str | None] = [None, "", " \n", "one two", "ONE\ttwo", "one two three four five", "É é", "é é"]
    passage = [word() for _ in range(60)]
    for _ in range(25):
        texts.append(" ".join([word() for _ in range(rng.randint(20, 200))] + passage + [word() for _ in range(20)]))
    for family in range(6):
        base = [word() for _ in range(rng.randint(60, 400))]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 25)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    chain = [word() for _ in range(200)]  # each links with the next only
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[12:] + [word() for _ in range(12)]
    texts += [texts[40], texts[41]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("most", [2000, 6])
def test_against_brute_force(spark, most):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, most=most).collect()}
    assert got == brute(rows)


def spied(monkeypatch) -> dict[str, list]:
    """What the join writes, by name."""
    seen: dict[str, list] = {}
    real = jaccard_join.written

    def spy(df, name, *more):
        out = real(df, name, *more)
        seen.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(jaccard_join, "written", spy)
    return seen


def test_pivots_and_windows_do_the_work(spark, monkeypatch):
    """Every document that could have a partner is measured against pivots, and what these leave open meets in shells and windows."""
    seen = spied(monkeypatch)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    jaccard_components(docs).collect()
    measured, members = seen["distances"][0], seen["members"][0]
    assert measured.select("p").distinct().count() > 20 and measured.count() > 30
    assert seen["shells"][0].count() > members.count() >= members.select("_d").distinct().count()
    linked = measured.filter("linked").count()
    assert 0 < linked < measured.count()


def family(n: int) -> list[tuple[int, str]]:
    """Texts of one boilerplate that links and breaks at every distance: most are over the reach from each other, some in chains."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(160)]
    parts = [[f"p{k}x{i}" for i in range(12)] for k in range(14)]
    out = []
    for i in range(n):
        own = words[: rng.randint(100, 160)]
        for k in rng.sample(range(14), rng.randint(0, 6)):
            own = own + parts[k]
        for _ in range(rng.choice([0, 1, 2])):
            own[rng.randrange(len(own))] = f"own{rng.randrange(40)}"
        out.append((i, " ".join(own)))
    return out


def test_a_large_family_goes_in_bounded_regions(spark, monkeypatch):
    seen = spied(monkeypatch)
    rows = family(1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, most=150).collect()}
    assert got == brute(rows)
    assert len({x for _, x in got.values()}) > 3
    largest = max(r["count"] for r in seen["members"][0].groupBy("region").count().collect())
    assert largest > 150 and "sizes" in seen  # so the split was needed


def test_repeated_rows_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (3, "q r s t u v"), (9, "q r s t u v"), (None, "z"), (5, "z"), (7, None)], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_components(docs).collect())
    assert rows == [(0, 1, 0), (3, 2, 3), (3, 2, 3), (3, 2, 3), (5, 1, 0), (7, 0, 7), (9, 2, 3)]
    assert jaccard_components(docs.limit(0)).collect() == []


def test_regions_find_all_links():
    rng = np.random.default_rng(2)
    centres = [rng.integers(0, 1 << 60, 100, dtype=np.uint64) for _ in range(12)]
    sets = []
    for _ in range(400):
        own = centres[rng.integers(12)].copy()
        change = rng.random(100) < rng.choice([0.02, 0.06, 0.1, 0.3])
        own[change] = rng.integers(0, 1 << 60, int(change.sum()), dtype=np.uint64)
        sets.append(np.unique(own))
    linked = Linked(len(sets))
    join_region(Sets(sets), linked, np.arange(len(sets)), 80)
    full = Linked(len(sets))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(x, sets[j]))
            if 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                full.join(i, np.array([j]))
    everyone = np.arange(len(sets))
    assert np.array_equal(linked.roots(everyone), full.roots(everyone))
    assert jaccard_join.REGION == 2000


def test_a_document_of_quotations_meets_only_its_like(spark):
    """Two copies of a compendium of 1,000 short texts are not measured against each of these."""
    rng = random.Random(9)
    short = [" ".join(str(rng.randrange(10**9)) for _ in range(30)) for _ in range(1000)]
    book = " ".join(short)
    texts = [*short, book, book.replace(short[7], "left out")]
    reps = [(i, np.unique(shingle_hashes(np.array([zlib.crc32(w.encode()) for w in t.split()], np.uint64), 5)).view(np.int64)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, len(x), x[: max(1, len(x) // 5 + 1)].tolist()) for i, x in reps], "_d long, n long, prefix array<long>")
    sent = jaccard_join.meetings(frame, 80).selectExpr("sum(8 * n)").first()[0] or 0
    assert sent < 10 * sum(map(len, texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert found[1001] == 1000 and all(found[i] == i for i in range(1001))

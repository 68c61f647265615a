"""find_runs against a plain search for every period, and the query against the contract's words."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tests.compare import SF_DIR

from tracewell.llm.periodic_runs import Ordered, chunk_runs, find_runs
from tracewell.llm.queries import op11_periodic_runs, periodic_texts


def words_of(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_runs(w: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, times * q):
                part = w[start : start + length]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.append((start, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (9, 3)])
def test_chunks_against_plain_search(least, times):
    rng = random.Random(least)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w = [rng.randrange(rng.choice([1, 2, 2, 3, 6])) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.5 and w:
                a, p = rng.randrange(len(w)), rng.randint(1, 8)
                w = [w[i] if i < a else w[a + (i - a) % min(p, len(w) - a)] for i in range(len(w))]
            texts.append(w)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        of, start, length, period = chunk_runs(np.array([x for w in texts for x in w], np.int64), bounds, least, times)
        for k, w in enumerate(texts):
            assert list(zip(start[of == k], length[of == k], period[of == k], strict=True)) == plain_runs(w, least, times)


def test_ordered_positions():
    rng = random.Random(1)
    at = rng.sample(range(100_000), 20_000)
    held, seen = Ordered(at[0]), [at[0]]
    for x in at[1:]:
        before, after = held.add(x)
        if len(seen) % 997 == 0:
            assert before == max((y for y in seen if y < x), default=-1) and after == min((y for y in seen if y > x), default=-1)
        seen.append(x)
    assert list(held) == sorted(at)


def test_texts_of_every_kind(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a " * 5, "a " * 6, "\x0ba  b\x1fc a b\x1fc a b\x1fc a b\x1fc a b\x1fc end", "é ü " * 40 + "last", " ".join(str(i) for i in range(3000))]
    texts += [" ".join(rng.choices("ab", k=rng.randint(0, 90))) for _ in range(40)] + ["x y z " * 30] * 3
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, i) for i, t in enumerate(texts)], "doc_id long, text string, runs int")
    found = find_runs(docs).collect()
    key = lambda x: str(x)
    expected = []
    for i, t in enumerate(texts):
        runs = plain_runs(words_of(t))
        expected.append((None if i == 3 else i // 2, len(words_of(t)), runs, collapsed(words_of(t), runs)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=key) == sorted(expected, key=key)
    assert find_runs(docs.limit(0)).collect() == []


def test_very_long_texts(spark):
    texts = ["a b c " * 100_000, " ".join(str(i) for i in range(200_000)) + " z" * 50_000]
    rows = {r.doc_id: r for r in find_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [tuple(x) for x in rows[0].runs] == [(0, 300_000, 3)] and rows[0].collapsed == "a b c"
    assert [tuple(x) for x in rows[1].runs] == [(200_000, 50_000, 1)] and rows[1].collapsed.endswith("199999 z")


def test_the_query_against_its_contract(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert periodic_texts(spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")).count() == 2
    found = {r.doc_id: r for r in op11_periodic_runs(spark, SF_DIR).collect()}
    assert len(found) == len(docs)
    damaged = 0
    for d in docs:
        w, h = words_of(d.text), zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            damaged += 1
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        row = found[d.doc_id]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert damaged > 5

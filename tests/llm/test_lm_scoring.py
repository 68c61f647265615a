"""score_documents against the model's definition, and the automaton's probabilities against their sum."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tracewell.llm.lm_scoring import Automaton, from_planes, pack_counts, planes, score_documents, unpack_counts

A_Z = {c: c + 32 for c in range(65, 91)}


def tokens_of(text: str | None) -> list[str]:
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(A_Z)), "\n"]


def defined(rows: list[tuple], order: int, prior: float) -> list[tuple]:
    """By the definition: (n_tokens, n_known, train_tokens, base, score) of each row (id, text, held out)."""
    counts: Counter = Counter()
    for _, text, held in rows:
        if not held:
            padded = ["\t"] * (order - 1) + tokens_of(text)
            for k in range(order):
                for i in range(order - 1, len(padded)):
                    counts[tuple(padded[i - k : i + 1])] += 1
            for k in range(1, order):
                counts[("\t",) * k] += 1
    n = sum(c for g, c in counts.items() if len(g) == 1 and g != ("\t",))
    v = sum(len(g) == 1 and g != ("\t",) for g in counts)

    def p(history: tuple, w: str) -> float:
        if not history:
            return (counts[w,] + 1) / (n + v + 1)
        lower = p(history[1:], w)
        return (counts[*history, w] + prior * lower) / (counts[history] + prior) if counts[history] else lower

    out = []
    for _, text, _ in rows:
        own = tokens_of(text)
        padded = ["\t"] * (order - 1) + own
        score = sum(math.log10(p(tuple(padded[i : i + order - 1]), w)) for i, w in enumerate(own))
        out.append((len(own), sum(counts[w,] > 0 for w in own), n, sum(math.log10((counts[w,] + 1) / (n + v + 1)) for w in own), score))
    return out


@pytest.mark.parametrize(("order", "block", "grams"), [(1, 1 << 20, 1 << 20), (2, 1 << 20, 1 << 20), (2, 40, 30), (3, 1 << 20, 1 << 20), (3, 700, 50), (4, 100, 1000)])
def test_against_the_definition(spark, order, block, grams):
    rng = random.Random(order)
    text = lambda n: " ".join(rng.choices(["the", "The", "cat", "sat", "é", "on", "mat", "MAT", "\x0bx"], k=n))
    rows = [(i, text(rng.randint(0, 30)), rng.random() < 0.3) for i in range(40)]
    rows += [(50, None, False), (51, "", True), (None, "never seen words", True), (52, text(1500), False), (53, text(1500), True), (54, "same row", False), (54, "same row", False)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, held boolean, score double")
    found = sorted(((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in score_documents(docs, "held", order, 3.0, block, grams).collect()), key=repr)
    expected = sorted(((r[0] or -1, r[2], *x) for r, x in zip(rows, defined(rows, order, 3.0), strict=True)), key=repr)
    assert len(found) == len(rows)
    for a, b in zip(sorted(found, key=lambda r: r[:4]), sorted(expected, key=lambda r: r[:4]), strict=True):
        assert a[:5] == b[:5]
    assert np.allclose(sorted(r[5] for r in found), sorted(r[5] for r in expected)) and np.allclose(sorted(r[6] for r in found), sorted(r[6] for r in expected))
    by_id = {r[0]: r for r in found if r[0] >= 0}
    assert all(np.allclose(by_id[r[0]][5:], r[5:]) for r in expected if r[0] >= 0)


def test_empty_tables_and_no_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b", True), (2, None, None)], "doc_id long, text string, held boolean")
    assert score_documents(docs.limit(0), "held").collect() == []
    row = score_documents(docs.filter("doc_id = 1"), "held").first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert [r.held_out for r in score_documents(docs, "held").orderBy("doc_id").collect()] == [True, False]


def test_probabilities_of_a_state_sum_to_one():
    """Over the known words and one that stands for all others."""
    rng = np.random.default_rng(1)
    size, stream = 6, rng.integers(0, 5, 300)
    grams, counts = [], []
    for k in (1, 2, 3):
        kinds, times = np.unique(np.stack([np.roll(stream, -i) for i in range(k)], axis=1), axis=0, return_counts=True)  # in a circle, so that every context goes on
        grams.append(kinds)
        counts.append(times)
    grams[0], counts[0] = np.concatenate([grams[0], [[5]]]), np.append(counts[0], 0)
    machine = Automaton(size, grams, counts, 300, 5, 4.0)
    for a in range(5):
        for b in range(5):
            lines = np.array([[a, b, w] for w in range(size)]).ravel()
            score = machine.walk(lines, np.arange(0, 3 * size, 3), np.full(size, 3), 2)
            assert abs((10**score).sum() - 1) < 1e-9


def test_packed_numbers():
    rng = np.random.default_rng(2)
    counts = np.concatenate([rng.integers(0, 3, 500), rng.integers(0, 2**40, 20), [254, 255, 256]])
    assert (unpack_counts(pack_counts(counts), len(counts)) == counts).all()
    keys = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    assert (from_planes(planes(keys), np.uint64) == keys).all()

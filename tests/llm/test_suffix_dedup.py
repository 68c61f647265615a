"""drop_repeats against brute force over all strings of the length."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tracewell.llm.suffix_dedup import Suffixes, drop_repeats

LENGTH = 200


def brute(texts: list[str | None]) -> list[tuple[int, int, int, bytes]]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + LENGTH] for x in data for i in range(len(x) - LENGTH + 1))
    out = []
    for x in data:
        gone = [False] * len(x)
        for i in range(len(x) - LENGTH + 1):
            if seen[x[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = [True] * LENGTH
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(x), sum(gone), runs, bytes(b for b, g in zip(x, gone, strict=True) if not g)))
    return out


def corpus() -> list[str | None]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(70), text(300)
    texts: list[str | None] = [text(rng.randint(1, 120)) for _ in range(20)]
    texts += [text(30) + passage + text(30) for _ in range(8)] + [passage, passage]
    for _ in range(8):  # near copies
        words = base.split(" ")
        for _ in range(4):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [base, base, None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 400, text(40) + passage[:199], "q" * 250 + text(10) + "q" * 230]
    return texts


@pytest.mark.parametrize(("hot", "bits"), [(4_000, 64), (1, 64), (4_000, 0), (20, 3)])
def test_against_brute_force(spark, hot, bits):
    """Also on the route of hot grams, and with hashes of contexts and windows that nearly all collide."""
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in drop_repeats(docs, LENGTH, hot, 1, bits).collect()}
    expected = brute(texts)
    assert rows == dict(enumerate(expected))
    assert sum(x[1] for x in expected) > 5000


@pytest.mark.parametrize("hot", [4_000, 1])
def test_equal_hashes_alone_remove_nothing(spark, hot):
    """Every context and window of one gram has the same hash, and none repeats."""
    rng = random.Random(2)
    gram = "".join(rng.choice("abcdefgh") for _ in range(60))
    texts = ["".join(rng.choice("ijklmnop") for _ in range(170)) + gram + "".join(rng.choice("ijklmnop") for _ in range(170)) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in drop_repeats(docs, LENGTH, hot, 1, 62 if hot == 1 else 0).collect()] == [0] * 4


def test_nulls_repeated_rows_and_empty_table(spark):
    rows = [(None, None), (None, "a" * 150), (None, "b" * 230), (None, "b" * 230), (7, "long " * 50), (7, "long " * 50)]
    rows += [(8, "".join(random.Random(3).choice("abcdefg") for _ in range(400)))] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in drop_repeats(docs).collect())
    assert rows == [(0, 0, 0, 0), (0, 150, 0, 0), (0, 230, 230, 1), (0, 230, 230, 1), (7, 250, 250, 1), (7, 250, 250, 1), *[(8, 400, 400, 1)] * 3]
    assert drop_repeats(docs.limit(0)).collect() == []


def test_very_long_texts(spark):
    """Texts over a piece's size: one of one letter, and one that holds parts of itself and of another."""
    rng = np.random.default_rng(1)
    own = bytes(rng.integers(97, 123, 5_000_000).astype(np.uint8)).decode()
    texts = ["z" * 20_000_000, own + own[2_000_000:2_150_000] + "A", own[4_900_000:] + own[:1_000], "no repeat in this one " + own[:100]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in drop_repeats(docs).collect()}
    cut = own[1_000:2_000_000] + own[2_150_000:4_900_000] + "A"
    assert [(rows[i].n_bytes, rows[i].n_removed) for i in range(4)] == [(20_000_000, 20_000_000), (5_150_001, 401_000 + 0), (101_000, 101_000), (len(texts[3]), 0)] and rows[3].n_spans == 0
    assert bytes(rows[1].kept).decode() == cut and rows[1].n_spans == 3


def test_equal_strings_among_equal_hashes():
    data = np.frombuffer(b"abcabdabcabe" * 2, np.uint8)
    sorting = Suffixes(data, 3)
    sorting.whole[:] = 1
    starts = np.array([0, 3, 6, 9])
    assert sorting.repeated(starts, np.zeros(4, np.int64)).tolist() == [True, False, True, False]


def test_mergesort_orders_suffixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    starts, length = np.sort(rng.integers(0, 2500, 500)), 60
    group = np.sort(rng.integers(0, 20, 500))
    order = Suffixes(data, length).sort(starts, group)
    keys = [(g, data[s : s + length].tobytes()) for g, s in zip(group, starts, strict=True)]
    assert [keys[i] for i in order] == sorted(keys)

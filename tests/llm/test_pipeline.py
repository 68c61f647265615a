"""Each stage of the pipeline against its rule on its own input, over the smallest tables and a table of odd rows."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tests.compare import SF_DIR
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_operators import brute_hits

import corpus_pipeline as P


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in P.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((docs.collect(), after.collect()))
        docs = after
    return out


def test_quality_only_drops(stages):
    before, after = stages[0]
    assert set(after) <= set(before) and 0.7 * len(before) < len(after) < len(before)
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) >= 50 for r in after)
    junk = [r for r in before if len(re.findall(r"[#*$%&]", r.text)) > 0.25 * r.n_chars]
    assert junk and not {r.doc_id for r in junk} & {r.doc_id for r in after}


def test_lines_stay_in_one_document(stages):
    before, after = stages[1]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held: dict[str, set[int]] = {}
    for r in before:
        for line in r.text.split("\n"):
            held.setdefault(key(line), set()).add(r.doc_id)
    expected = {}
    for r in before:
        kept = [x for x in r.text.split("\n") if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == r.doc_id]
        text = "\n".join(kept)
        if len(kept) == len(r.text.split("\n")) or text.strip(" \t\n\x0b\x0c\r"):
            expected[r.doc_id] = text
    assert {r.doc_id: r.text for r in after} == expected and all(r.n_chars == len(r.text) for r in after)


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    groups = components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(d for d, (_, root) in groups.items() if d == root)
    assert set(after) <= set(before)


def test_contaminated_documents_go(stages, spark):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert set(after) == {r for r in before if not brute_hits(r.text, items)[1]}


def test_all_that_is_left_is_packed(stages):
    before, after = stages[4]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert sorted(r.sequence_id for r in after) == list(range(len(after)))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d in before:
        ids, at = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted((r for r in after if r.doc_id == d.doc_id), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_odd_rows_pass_through(spark):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 60, "en", None, 300), (2, "word " * 60, "en", None, 300)]
    odd += [(3, " ".join(f"w{i}" for i in range(80)), None, "s", 1)] * 3
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda rows: sorted(-1 if r.doc_id is None else r.doc_id for r in rows)
    # what is short, null or one word over and over goes; lines that no three documents hold stay; one of equal rows stays; nothing is of the benchmark
    kept = [[3, 3, 3], [-1, 1, 1, 2, 2, 3, 3, 3], [-1, 1, 2, 3], [-1, 1, 1, 2, 2, 3, 3, 3]]
    for (_, stage), expected in zip(P.STAGES, kept, strict=False):
        rows = stage(spark, docs, SF_DIR)
        empty = stage(spark, docs.limit(0), SF_DIR)
        assert empty.columns == rows.columns and empty.count() == 0 and ids(rows.collect()) == expected
    packed = P.packing(spark, docs, SF_DIR).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"), F.count_if(F.col("start") == 0).alias("k")).collect()
    assert {(r.doc_id, r.k) for r in packed} == {(None, 1), (1, 2), (2, 2), (3, 3)} and all(r.n == r.k * r.t for r in packed)
    assert P.near_duplicates(spark, docs, SF_DIR).filter(F.col("doc_id") == 3).count() == 1


def test_different_texts_under_null_or_repeated_ids_stay(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    rows = [(None, text(k)) for k in range(20)] + [(None, text(0)), (None, text(1) + " more")] + [(7, text(k)) for k in range(30, 40)]
    rows += [(7, text(30)), (7, text(31) + " more"), (8, text(32)), (5, text(33)), (9, text(50)), (9, text(50))]
    rows += [(None, None), (None, ""), (11, ""), (11, ""), (12, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in P.near_duplicates(spark, docs, SF_DIR).collect()]
    first = {t.removesuffix(" more") for _, t in got if t}
    assert first == {text(k) for k in (*range(20), *range(30, 40), 50)} and len(got) == 31 + 3
    assert (5, text(33)) in got and (7, text(33)) not in got and (8, text(32)) not in got and sum(d is None for d, _ in got) == 21


def test_vertices_tell_rows_apart(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, None), (0, None), (0, "")]
    found = P.vertices(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["_k"] for r in found}) == 5 and len({(r.doc_id, r.text or "", r["_k"]) for r in found}) == 5

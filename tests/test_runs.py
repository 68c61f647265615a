from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tracewell.operators import runs


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    for i in range(6):
        (root / f"a{i}.txt").write_text(f"text number {i}\n\nsecond part")
    (root / "sub" / "b.sql").write_text("select 1 from dual;")
    (root / "bad.txt").write_bytes(b"\xff\xfeA")  # half a UTF-16 character
    (root / "other.bin").write_bytes(b"x")
    return root


def decided(state):
    return {os.path.basename(r.path): (r.decision, r.status) for r in state.collect()}


def test_runs_over_files(spark, corpus, tmp_path):
    table, sign = str(tmp_path / "table"), runs.signature(size=4000, encodings=["utf-8"])
    run = lambda n, roots=None, s=sign, **k: decided(runs.ingest(spark, roots or [str(corpus)], table, n, [".txt", ".sql"], s, **k))
    first = run(1)
    assert first == {**{f"a{i}.txt": ("new", "processed") for i in range(6)}, "b.sql": ("new", "processed"), "bad.txt": ("new", "error")}
    texts = lambda n: sorted(r.content for r in runs.chunks_of(spark, table, n).collect())
    assert len(texts(1)) == 7
    # nothing changed: only the failed file is tried again
    second = run(2)
    assert second.pop("bad.txt") == ("previous_error", "error")
    assert set(second.values()) == {("unchanged", "processed")} and texts(2) == texts(1)
    # one changed, one touched, one gone, one new
    (corpus / "a0.txt").write_text("other words")
    os.utime(corpus / "a1.txt", ns=(10**18, 2 * 10**18))
    (corpus / "a2.txt").unlink()
    (corpus / "c.txt").write_text("fresh")
    third = run(3)
    assert third["a0.txt"] == ("content_changed", "processed") and third["a1.txt"] == ("touch", "processed")
    assert third["a2.txt"] == ("deleted", "deleted") and third["c.txt"] == ("new", "processed") and third["a3.txt"] == ("unchanged", "processed")
    now = texts(3)
    assert "other words" in now and "fresh" in now and not any("number 0" in t or "number 2" in t for t in now) and len(now) == 7
    # a root that is not there deletes nothing, and what was deleted is forgotten
    fourth = run(4, [str(tmp_path / "nowhere")])
    assert set(d for d, _ in fourth.values()) == {"root_not_listed"} and "a2.txt" not in fourth and texts(4) == now
    # other settings, and a full run, take everything again
    assert {d for n, (d, _) in run(5, s=runs.signature(size=100)).items() if n != "bad.txt"} == {"signature_changed"}
    assert {d for d, _ in run(6, full=True).values()} == {"full"} and texts(6) == now
    counts = {r.decision: r.n for r in runs.run_counts(runs.files_of(spark, table, 3)).collect()}
    assert counts == {"content_changed": 1, "touch": 1, "deleted": 1, "new": 1, "unchanged": 4, "previous_error": 1}


def test_overlapping_roots_and_large_files(spark, corpus, tmp_path):
    (corpus / "large.txt").write_text("x" * 500)
    state = runs.ingest(spark, [str(corpus / "sub"), str(corpus)], str(tmp_path / "t"), 1, [".txt", ".sql"], "s", most_bytes=200)
    rows = {os.path.basename(r.path): r for r in state.collect()}
    assert rows["b.sql"].root.endswith("/sub") and rows["large.txt"].status == "skipped" and rows["large.txt"].error == "FILE_TOO_LARGE"
    assert state.count() == 9


def test_no_files(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert runs.ingest(spark, [str(tmp_path / "empty"), str(tmp_path / "none")], str(tmp_path / "t"), 1, [".txt"], "s").count() == 0
    assert runs.chunks_of(spark, str(tmp_path / "t"), 1).count() == 0


def test_index_runs(spark):
    chunks = spark.createDataFrame([(1, "one"), (2, "two"), (3, " "), (4, "four")], "chunk_id long, content string").withColumn("sha256", F.sha2("content", 256))
    none = spark.createDataFrame([], "chunk_id long, sha256 string, status string, embedding array<double>")
    first = runs.index(chunks, none, 8)
    got = {r.chunk_id: (r.action, r.status, r.error) for r in first.collect()}
    assert got == {1: ("new", "indexed", None), 2: ("new", "indexed", None), 3: ("new", "error", "EMPTY_CONTENT"), 4: ("new", "indexed", None)}
    later = chunks.filter("chunk_id != 4").withColumn("content", F.when(F.col("chunk_id") == 2, "zwei").otherwise(F.col("content"))).withColumn("sha256", F.sha2("content", 256))
    second = runs.index(later, first, 8)
    got = {r.chunk_id: (r.action, r.status) for r in second.collect()}
    assert got == {1: ("unchanged", "indexed"), 2: ("update", "indexed"), 3: ("update", "error"), 4: ("delete", "deleted")}
    before = {r.chunk_id: r.embedding for r in first.collect()}
    after = {r.chunk_id: r.embedding for r in second.collect()}
    assert before[1] == after[1] and before[2] != after[2] and after[4] is None
    scope = runs.index(runs.scoped(later.withColumn("relative_path", F.lit("a/b")), path="a/", chunk_id=1), first, 8, whole=False)
    assert [(r.chunk_id, r.action) for r in scope.collect()] == [(1, "unchanged")]
    assert {r.error for r in runs.index(chunks, none, 5).filter("chunk_id != 3").collect()} == {"DIMENSION_MISMATCH"}


def test_versions():
    assert runs.signature(a=1, b=[2]) == runs.signature(b=[2], a=1) != runs.signature(a=1, b=[3])
    assert runs.manifest_version("fake", "sha256", 8) != runs.manifest_version("fake", "sha256", 16)
    with pytest.raises(ValueError):
        runs.manifest_version("fake", "", 8)

"""What has to be done again: files, chunks, and rows of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_decisions(found: DataFrame, known: DataFrame, signature: str, full: bool = False) -> DataFrame:
    """What to do with each found file; the first reason that holds.

    found: path, size_bytes, modified_ns, sha256 (null where it was not hashed yet). known: path, size_bytes, modified_ns, sha256,
    signature, status. Out: found's columns with decision and process.
    """
    old = known.select("path", *[F.col(c).alias(f"_{c}") for c in ("size_bytes", "modified_ns", "sha256", "signature", "status")])
    same_stat = (F.col("size_bytes") == F.col("_size_bytes")) & (F.col("modified_ns") == F.col("_modified_ns"))
    decision = (
        F.when(F.lit(full), "full")
        .when(F.col("_status").isNull(), "new")
        .when(F.col("_status") == "error", "previous_error")
        .when(F.col("_status") != "processed", "not_processed")
        .when(F.col("_signature") != signature, "signature_changed")
        .when(same_stat, "unchanged")
        .when(F.col("sha256").isNull(), "hash_required")
        .when(F.col("sha256") == F.col("_sha256"), "touch")
        .otherwise("content_changed")
    )
    out = found.join(old, "path", "left").withColumn("decision", decision)
    return out.withColumn("process", ~F.col("decision").isin("unchanged", "touch", "hash_required")).select(*found.columns, "decision", "process")


def index_plan(chunks: DataFrame, states: DataFrame, full: bool = False, delete_obsolete: bool = True) -> DataFrame:
    """new, update, unchanged or delete for each chunk. chunks: chunk_id, sha256. states: chunk_id, sha256, status."""
    now = chunks.select("chunk_id", "sha256", F.lit(True).alias("_now"))
    old = states.select("chunk_id", F.col("sha256").alias("_sha256"), F.col("status").alias("_status"))
    both = now.join(old, "chunk_id", "full_outer")
    action = (
        F.when(F.col("_now").isNull(), "delete")
        .when(F.lit(full) | F.col("_status").isNull(), "new")
        .when((F.col("_status") != "indexed") | (F.col("_sha256") != F.col("sha256")), "update")
        .otherwise("unchanged")
    )
    out = both.select("chunk_id", action.alias("action"))
    return out if delete_obsolete else out.filter("action != 'delete'")


def deleted_files(known: DataFrame, found: DataFrame, completed_roots: list[str]) -> DataFrame:
    """Known files under a completely walked root that were not found. known and found: root, path."""
    return known.filter(F.col("root").isin(completed_roots)).join(found.select("root", "path"), ["root", "path"], "left_anti")


def stale_rows(rows: DataFrame, files: DataFrame, run: int) -> DataFrame:
    """Rows of the given files that this run did not touch. rows: file_id, last_run_id."""
    return rows.filter(F.col("last_run_id") != run).join(files.select("file_id"), "file_id", "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], created: str = "created_at") -> DataFrame:
    """new's rows over old's of equal keys, which keep when they were created."""
    kept = old.join(new.select(*keys), keys, "left_anti")
    before = old.select(*keys, F.col(created).alias("_created"))
    fresh = new.join(before, keys, "left").withColumn(created, F.coalesce("_created", created)).select(*old.columns)
    return kept.select(*old.columns).unionByName(fresh)


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that are in new, replaced by new's: a file's chunks, a relation's candidates."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def union_first(frames: list[DataFrame], key: str) -> DataFrame:
    """The rows of all frames, one for each key: that of the first frame that has it."""
    out = None
    for i, df in enumerate(frames):
        ranked = df.withColumn("_rank", F.lit(i))
        out = ranked if out is None else out.unionByName(ranked)
    others = [c for c in frames[0].columns if c != key]
    return out.groupBy(key).agg(F.min_by(F.struct(*others), F.struct("_rank", *others)).alias("_row")).select(key, "_row.*")

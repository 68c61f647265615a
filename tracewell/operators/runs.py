"""Ingestion and index runs over versioned tables: what changed is worked off, what failed is recorded, what is gone is reconciled."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import vectors as V
from tracewell.functions.text import normalize_newlines
from tracewell.operators.context import chunk_documents
from tracewell.operators.incremental import file_decisions, index_plan
from tracewell.plans.materialize import written
from tracewell.sources.files import decode, discover, snapshot_write

FILES = "root string, path string, extension string, size_bytes long, modified_ns long, sha256 string, signature string, status string, error string, decision string, chunks_run int"


def signature(**settings) -> str:
    """A hash of everything that changes what a file becomes (versions, sizes, encodings, declared tables): equal settings in any order of names, equal signature."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), default=list).encode()).hexdigest()


def manifest_version(provider: str, model: str, dimension: int, distance: str = "cosine", normalize: bool = True) -> str:
    """The version of an index: vectors of different versions never meet."""
    if not provider or not model or not distance or dimension <= 0:
        raise ValueError("provider, model, distance and a dimension above 0 are needed")
    settings = {"provider": provider, "model": model, "dimension": dimension, "distance": distance, "normalize": normalize}
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def active_manifest(manifests: DataFrame, version: str) -> DataFrame:
    """The newest active manifest of a version: one row or none. manifests: id, version, status."""
    return manifests.filter((F.col("version") == version) & (F.col("status") == "active")).orderBy(F.desc("id")).limit(1)


def files_of(spark: SparkSession, table: str, run: int) -> DataFrame:
    """The files' state after a run; none before the first."""
    if run <= 0:
        return spark.createDataFrame([], FILES)
    return spark.read.schema(FILES).parquet(f"{table.rstrip('/')}/files/version={run:08d}")


def chunks_of(spark: SparkSession, table: str, run: int) -> DataFrame:
    """The current chunks after a run: those that each file's last processing wrote. Earlier ones stay on disk and are not read as current."""
    current = files_of(spark, table, run).filter("chunks_run is not null and status != 'deleted'").select(F.col("path").alias("document_id"), F.col("chunks_run").alias("run"))
    stored = spark.read.option("basePath", f"{table.rstrip('/')}/chunks").parquet(f"{table.rstrip('/')}/chunks")
    return stored.join(current, ["document_id", "run"], "left_semi").drop("run")


def ingest(spark: SparkSession, roots: list[str], table: str, run: int, extensions: list[str], settings: str, full: bool = False, ignore: tuple[str, ...] = (), most_bytes: int = 50 << 20,
           size: int = 4000, overlap: int = 200) -> DataFrame:
    """Run number ``run`` (from 1) over the roots; returns the files' new state with each file's decision.

    A file under two roots belongs to the first. Size and time of change say which files may have changed; only contents changed since the oldest of these are read. Unreadable
    texts and files over ``most_bytes`` are rows of status error and skipped, with the reason, and are tried again next time; the run goes on. A file that is gone is ``deleted`` if its root was listed;
    a root that cannot be listed deletes nothing. Chunks are only added, by run; the files' table says which are current, so that a run writes what changed and a row a file.
    """
    known = files_of(spark, table, run - 1).filter("status != 'deleted'")
    found, listed = None, []
    for root in roots:
        try:
            part = discover(spark, root, extensions, list(ignore), most_bytes)
        except AnalysisException as failure:
            if failure.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        listed.append(root)
        path = F.concat(F.lit(root.rstrip("/") + "/"), "relative_path")
        part = part.withColumns({"root": F.lit(root), "path": path, "_order": F.lit(len(listed)), "modified_ns": F.unix_micros("modified_at") * 1000})
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "root string, path string, extension string, size_bytes long, modified_ns long, modified_at timestamp, content binary, sha256 string, status string, _order int, relative_path string")
    columns = ["root", "path", "extension", "size_bytes", "modified_ns"]
    stat = found.groupBy("path").agg(F.min_by(F.struct("root", "extension", "size_bytes", "modified_ns", "modified_at", "status", "relative_path"), "_order").alias("_s")).select("path", "_s.*")
    first = file_decisions(stat.withColumn("sha256", F.lit(None).cast("string")), known, settings, full)
    first = written(first.withColumn("decision", F.when((F.col("status") != "found") & (F.col("decision") == "unchanged"), "not_processed").otherwise(F.col("decision"))), "decisions")
    open_ = first.filter("decision != 'unchanged'")
    since = open_.agg(F.min("modified_at")).first()[0]  # one value
    before = known.select("path", "sha256", "signature", "status", "error", "chunks_run")
    parts = []
    if since is not None:
        read = found.filter(F.col("modified_at") >= F.lit(since)).join(open_.select("root", "path"), ["root", "path"], "left_semi")
        second = file_decisions(read.select(*columns, "content", "sha256", "status"), known, settings, full).withColumnRenamed("status", "_found")
        texts = decode(second.filter("decision != 'touch'"))
        failed = F.when(F.col("_found") != "found", F.col("_found")).when(F.col("text").isNull(), F.coalesce("warning", F.lit("TEXT_DECODE_FAILED")))
        texts = written(texts.withColumn("error", failed).select(*columns, "sha256", "decision", "_found", "error", F.when(failed.isNull(), normalize_newlines(F.col("text"))).alias("text")), "texts")
        status = F.when(F.col("error").isNull(), "processed").when(F.col("_found") != "found", "skipped").otherwise("error")
        parts.append(texts.select(*columns, "sha256", F.lit(settings).alias("signature"), status.alias("status"), "error", "decision", F.when(F.col("error").isNull(), run).alias("chunks_run")))
        parts.append(second.filter("decision = 'touch'").select(*columns, "decision").join(before, "path"))
        whole = texts.filter("error is null").select(F.col("path").alias("document_id"), "text")
    else:
        whole = spark.createDataFrame([], "document_id string, text string")
    if since is not None or run == 1:
        chunk_documents(whole, size, overlap).write.mode("errorifexists").parquet(f"{table.rstrip('/')}/chunks/run={run}")
    same = first.filter("decision = 'unchanged'").select(*columns, "decision").join(before, "path")
    gone = known.join(first.select("path"), "path", "left_anti")
    deleted = F.col("root").isin(*listed) if listed else F.lit(False)
    gone = gone.withColumns({"status": F.when(deleted, "deleted").otherwise(F.col("status")), "decision": F.when(deleted, "deleted").otherwise("root_not_listed"), "chunks_run": F.when(~deleted, F.col("chunks_run"))})
    names = [field.split(" ")[0] for field in FILES.split(", ")]
    state = gone.select(*names)
    for more in (same, *parts):
        state = state.unionByName(more.select(*names))
    path = snapshot_write(state, f"{table.rstrip('/')}/files", run)
    return spark.read.schema(FILES).parquet(path)


def run_counts(rows: DataFrame, column: str = "decision") -> DataFrame:
    """How many rows each decision or action has."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def scoped(chunks: DataFrame, path: str | None = None, document_id=None, chunk_id=None) -> DataFrame:
    """The part of an index run that was asked for: a prefix of the path, a document, a chunk."""
    out = chunks
    if path is not None:
        out = out.filter(F.startswith("relative_path", F.lit(path)))
    for name, value in (("document_id", document_id), ("chunk_id", chunk_id)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out


def index(chunks: DataFrame, states: DataFrame, dimension: int, full: bool = False, whole: bool = True, embed=V.digest_embedding) -> DataFrame:
    """An index run: (chunk_id, action, status, sha256, embedding, error) of every chunk and every state.

    chunks: chunk_id, sha256, content. states: chunk_id, sha256, status, embedding. ``embed`` makes a column of vectors from a column of texts, and is asked for new and changed chunks only. A blank text or a vector of another dimension
    is an error of its chunk, which the next run tries again. States without a chunk are deleted if the run is ``whole``, not of a scope.
    """
    plan = index_plan(chunks, states, full, whole)
    old = states.select("chunk_id", F.col("embedding").alias("_old"), F.col("sha256").alias("_sha"))
    kept = plan.filter("action in ('unchanged', 'delete')").join(old, "chunk_id").select(
        "chunk_id", "action", F.when(F.col("action") == "delete", "deleted").otherwise("indexed").alias("status"), F.col("_sha").alias("sha256"), F.when(F.col("action") != "delete", F.col("_old")).alias("embedding"), F.lit(None).cast("string").alias("error")
    )
    work = chunks.select("chunk_id", "sha256", "content").join(plan.filter("action in ('new', 'update')"), "chunk_id")
    blank = F.coalesce(F.btrim("content", F.lit(" \t\r\n")), F.lit("")) == ""
    made = work.withColumn("embedding", F.when(~blank, embed(F.col("content"))))
    error: Column = F.when(F.col("embedding").isNull(), "EMPTY_CONTENT").when(F.size("embedding") != dimension, "DIMENSION_MISMATCH")
    made = made.withColumn("error", error)
    good = F.col("error").isNull()
    made = made.select("chunk_id", "action", F.when(good, "indexed").otherwise("error").alias("status"), "sha256", F.when(good, F.col("embedding")).alias("embedding"), "error")
    return kept.unionByName(made)

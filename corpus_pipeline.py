"""The training-data pipeline: five stages over documents, each one operator of tracewell.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import id_or_lowest, written
from tracewell.llm.decontaminate import decontaminate
from tracewell.llm.jaccard_join import jaccard_components
from tracewell.llm.line_dedup import dedup_lines
from tracewell.llm.packing import pack_documents
from tracewell.llm.quality import judge_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Rows of one doc_id stay or go by themselves, repeated ones alike; null and empty texts go, as texts under 50 words do. Null languages and sources are groups of their own. An empty table gives an empty table."""
    judged = judge_quality(docs, keep=("text", "lang", "source", "n_chars"))
    return judged.filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in one; n_chars follows. Documents that had text and are left without any go. Null texts become empty ones; repeated rows are cut alike. An empty table gives an empty table."""
    cut = dedup_lines(docs, keep=("lang", "source"))
    empty = (F.col("n_dropped") > 0) & (F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) == "")
    return cut.filter(~empty).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def vertices(rows: DataFrame) -> DataFrame:
    """rows with _k: equal for rows of one doc_id and text, different for all others.

    It is a hash of both. Rows of different ids or texts under one hash, which a second hash tells, take another one, until there are none.
    """
    told = (F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")))
    hashed = lambda seed: F.xxhash64(F.lit(seed), *told)
    keyed, seed = rows.withColumn("_k", hashed(0)), 1
    while True:
        apart = keyed.select("_k", hashed(-seed).alias("_h")).groupBy("_k").agg(F.min("_h").alias("_a"), F.max("_h").alias("_z")).filter("_a != _z")
        clash = written(apart.select("_k", F.lit(True).alias("_clash")), "pipeline-clashes")
        if clash.isEmpty():
            return keyed
        keyed, seed = keyed.join(clash, "_k", "left").withColumn("_k", F.when(F.col("_clash"), hashed(seed)).otherwise(F.col("_k"))).drop("_clash"), seed + 1


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; of repeated rows of it, one.

    Rows under a null or repeated doc_id go only if their texts are near or equal. Null, empty and blank texts are near nothing. An empty table gives an empty table.
    """
    rows = vertices(docs.select(*COLUMNS))
    groups = jaccard_components(rows.select(F.col("_k").alias("doc_id"), "text")).select(F.col("doc_id").alias("_k"), "component_id").distinct()
    ids = rows.select("_k", id_or_lowest("doc_id").alias("_id")).distinct()
    kept = ids.join(groups, "_k").groupBy("component_id").agg(F.min_by("_k", F.struct("_id", "_k")).alias("_k")).select("_k")
    chosen = rows.join(kept, "_k", "left_semi")
    many = chosen.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_k")
    again = chosen.join(many, "_k", "left_semi").groupBy("_k").agg(F.min(F.struct(*COLUMNS)).alias("_row")).select("_row.*")
    return chosen.join(many, "_k", "left_anti").select(*COLUMNS).unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none and stay; repeated rows stay or go alike. An empty table or benchmark takes nothing away."""
    judged = decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.filter(~F.col("contaminated")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents by sequence, with a checksum of their token ids. A null or empty text is its end token alone; repeated rows are documents of their own; an empty table has no pieces."""
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The robust fit of the first stage and the tokens of the last have no SQL; the tests hold each stage against its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

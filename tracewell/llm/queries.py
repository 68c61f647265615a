"""The operators as registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import chat_format, conversation_repair, decontaminate, jaccard_join, license_scan, line_dedup, lm_scoring, packing, periodic_runs, quality, sharding, sql, suffix_dedup, url_filter
from tracewell.llm.common import id_or_lowest, id_or_null

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"), 200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(extra)))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "license", F.round("containment", 6).alias("containment"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def periodic_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text: in one of ten documents, by a checksum of its id, the words from a place on repeat themselves."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^ \t-\r]+)"), F.lit(1))
    chosen = docs.select("doc_id", "text", h.alias("_h"), g.alias("_g")).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    chosen = chosen.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    chosen = chosen.withColumn("_p", F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)) + 1)
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    repeated = F.transform("_w", lambda _, i: F.get("_w", place(i).cast("int")))
    return chosen.select("doc_id", F.when(F.col("_n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_texts(table(spark, sf_dir, "documents"))).withColumn("_best", periodic_runs.greatest_run(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{x}").alias(x) for x in ("start", "length", "period")],
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    out = lm_scoring.score_documents(docs.select("doc_id", "text", (remainder == 2).alias("held_out")), "held_out")
    rounded = [F.round(x, 6).alias(x) for x in ("base_score", "score")]
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", *rounded)


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of their conversation and turn: dropped, emptied, without stops, repeated, given to the user."""
    kind = F.crc32(F.concat(*[F.coalesce(F.col(x).cast("string"), F.lit(y)) for x, y in (("conv_id", " "), ("_colon", ":"), ("turn", " "))])) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(":").alias("_colon"))
    rows = rows.withColumn("_kind", kind).filter("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    report, repaired = conversation_repair.repair_conversations(damaged_turns(turns))
    every = turns.select(id_or_lowest("conv_id").alias("_c")).distinct()
    found = every.join(report.withColumn("_c", id_or_lowest("conv_id")).drop("conv_id"), "_c", "left").join(conversation_repair.repaired_digests(repaired), "_c", "left")
    numbers = [F.coalesce(x, F.lit(0)).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return found.select(id_or_null("_c").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), sha)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_sharding,
        op3_url_filter,
        op4_suffix_dedup,
        op5_decontaminate,
        op6_packing,
        op7_jaccard_join,
        op8_chat_format,
        op9_license_scan,
        op10_quality,
        op11_periodic_runs,
        op12_lm_scoring,
        op13_conversation_repair,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": sql.OP1,
        "op3_url_filter": sql.url_filter(URL_RULES),
        "op5_decontaminate": sql.OP5,
        "op7_jaccard_join": f"WITH RECURSIVE {sql.jaccard_components()}\nSELECT doc_id, n_shingles, component_id FROM grouped",
        "op8_chat_format": sql.chat_format(),
        "op9_license_scan": sql.license_scan(),
        "op12_lm_scoring": sql.lm_scoring(),
        "op13_conversation_repair": sql.conversation_repair(),
    }

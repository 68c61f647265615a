"""Keyword, vector and hybrid search, structured scoring, and their filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import text as T
from tracewell.functions import vectors as V

#: The artifact kind that a language stands for.
LANGUAGE_KINDS = {"plsql": "oracle", "powerscript": "powerbuilder", "markdown": "markdown", "text": "text", "config": "config"}


def keyword_filter(chunks: DataFrame, domain=None, artifact_kind=None, document_id=None, folder=None, extension=None, language=None) -> DataFrame:
    """Filters of keyword search: the folder is a prefix of the path in any case (its wildcards are live), an unknown language filters nothing."""
    out = chunks
    for name, value in (("domain", domain), ("artifact_kind", artifact_kind), ("document_id", document_id), ("extension", extension)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    if folder is not None:
        out = out.filter(F.col("relative_path").ilike(f"{folder}%"))
    if language is not None and (kind := LANGUAGE_KINDS.get(language)):
        out = out.filter(F.col("artifact_kind") == kind)
    return out


def vector_filter(vectors: DataFrame, **equal) -> DataFrame:
    """Filters of vector search: equality of every value given."""
    out = vectors
    for name, value in equal.items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out


def keyword_search(chunks: DataFrame, tokens: list[str], limit: int) -> DataFrame:
    """Chunks with any of the tokens, by score, path, ordinal and id.

    In: chunk_id, relative_path, ordinal, content. A top-k: Spark keeps each partition's best and merges those.
    """
    scored = chunks.withColumn("score", T.keyword_score(F.col("content"), tokens)).filter("score > 0")
    return scored.orderBy(F.desc("score"), "relative_path", "ordinal", "chunk_id").limit(limit)


def vector_search(vectors: DataFrame, query: list[float], limit: int, threshold: float = 0.0) -> DataFrame:
    """The ``limit`` nearest vectors by clamped cosine, then those of ``threshold`` or more. In: chunk_id, embedding."""
    score = V.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    nearest = vectors.withColumn("score", score).orderBy(F.desc("score"), "chunk_id").limit(limit)
    return nearest.filter(F.col("score") >= threshold)


def hybrid_fusion(vector: DataFrame, keyword: DataFrame, vector_weight: float, keyword_weight: float, limit: int, threshold: float = 0.0) -> DataFrame:
    """Candidates of both channels (chunk_id, score), each scaled to its own range, weighted and added.

    Candidates are the two searches' top rows, so the range of a channel is a window over at most that many.
    """
    if vector_weight < 0 or keyword_weight < 0 or vector_weight + keyword_weight <= 0:
        raise ValueError("weights must not be negative, nor both 0")
    best = lambda df, name: df.groupBy("chunk_id").agg(F.max("score").alias(name))
    both = best(vector, "vector_score").join(best(keyword, "keyword_score"), "chunk_id", "full_outer")
    every = Window.partitionBy(F.lit(0))  # two searches' top rows, read once
    scaled = both.withColumns({f"{c}_{n}": f(c).over(every) for c in ("vector_score", "keyword_score") for n, f in (("low", F.min), ("high", F.max))})
    part = lambda c: V.min_max(F.col(c), F.col(f"{c}_low"), F.col(f"{c}_high"))
    combined = (vector_weight * part("vector_score") + keyword_weight * part("keyword_score")) / (vector_weight + keyword_weight)
    out = scaled.withColumn("combined_score", combined).filter(F.col("combined_score") >= threshold)
    return out.orderBy(F.desc("combined_score"), "chunk_id").limit(limit).select("chunk_id", "vector_score", "keyword_score", "combined_score")


def concept_frequency(records: DataFrame) -> DataFrame:
    """In how many records each concept is. In: record_id, concepts (array). Out: concept, frequency, records."""
    total = records.select("record_id").distinct().agg(F.count(F.lit(1)).alias("records"))
    seen = records.select("record_id", F.explode("concepts").alias("concept")).distinct()
    counted = seen.groupBy("concept").agg(F.count(F.lit(1)).alias("frequency"))
    return counted.join(F.broadcast(total))  # one row


def structured_score(coverage: Column, quantity: Column, rarity: Column, precision: Column, several: Column, exact: Column) -> Column:
    """The weighted score of a structured record for a query's concepts; 1 at most."""
    total = 0.30 * coverage + 0.15 * quantity + 0.25 * rarity + 0.20 * precision
    total = total + F.when(several, 0.10).otherwise(0.0) + F.when(exact, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def structured_search(records: DataFrame, query: list[str], limit: int) -> DataFrame:
    """Records by the query's concepts in their name and body, rare concepts counting more.

    In: record_id, name, concepts (of the body). Precision is 1 if the name is a concept of the query, 0.9 if the name contains one, 0.5 else.
    """
    asked = F.array(*map(F.lit, query))
    frequency = concept_frequency(records).filter(F.col("concept").isin(query))
    matched = records.withColumn("concept", F.explode(F.array_intersect("concepts", asked))).select("record_id", "name", "concept")
    rarity = T.smoothed_idf(F.col("records"), F.col("frequency"))
    per_record = matched.join(frequency, "concept").groupBy("record_id", "name").agg(F.count(F.lit(1)).alias("matched"), F.max(rarity).alias("rarity"))
    name = F.lower("name")
    contains = F.exists(asked, lambda q: F.contains(name, q))
    precision = F.when(name.isin(query), 1.0).when(contains, 0.9).otherwise(0.5)
    coverage = F.col("matched") / F.lit(float(len(query)))
    score = structured_score(coverage, F.least(F.lit(1.0), F.col("matched") / F.lit(3.0)), F.col("rarity"), precision, F.col("matched") > 1, name.isin(query))
    return per_record.withColumn("score", score).orderBy(F.desc("score"), "record_id").limit(limit)


def relative_relevance(rows: DataFrame) -> DataFrame:
    """Relevance within a family from 1 down to 0 by dense rank. In: family, exact, score. Adds level and relevance."""
    # a family's different scores are ranked, not its rows
    order = Window.partitionBy("family").orderBy(F.desc("exact"), F.desc("score"))
    levels = rows.select("family", "exact", "score").distinct().withColumn("level", (F.dense_rank().over(order) - 1).cast("long"))
    named = levels.select(F.col("family").alias("_f"), F.col("exact").alias("_e"), F.col("score").alias("_s"), "level")
    same = F.col("family").eqNullSafe(F.col("_f")) & F.col("exact").eqNullSafe(F.col("_e")) & F.col("score").eqNullSafe(F.col("_s"))
    ranked = rows.join(named, same).drop("_f", "_e", "_s")
    top = levels.groupBy("family").agg(F.max("level").alias("_top"))
    relevance = F.when(F.col("_top") == 0, F.lit(1.0)).otherwise(1 - F.col("level") / F.nullif(F.col("_top"), F.lit(0)))
    return ranked.join(top, "family").withColumn("relevance", relevance).drop("_top")


def first_occurrences(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order, by one aggregation that combines before the shuffle (no window over a hot key)."""
    others = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*")


def enrich(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with their chunk's columns; what a candidate has already, wins. Nothing is dropped."""
    shared = [c for c in candidates.columns if c in chunks.columns and c != "chunk_id"]
    joined = candidates.alias("a").join(chunks.alias("b"), "chunk_id", "left")
    return joined.select(
        "chunk_id",
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in shared],
        *[F.col(f"a.{c}") for c in candidates.columns if c not in shared and c != "chunk_id"],
        *[F.col(f"b.{c}") for c in chunks.columns if c not in shared and c != "chunk_id"],
    )


def structured_filter(symbols: DataFrame, artifact_kind=None, language=None, document_id=None, folder=None, extension=None) -> DataFrame:
    """Filters of structured search: the folder is a prefix of the path's folder with its case, the extension an ending in any case, and only Oracle and PowerBuilder have a language.

    In: relative_path, artifact_kind (null: the technology), technology, document_id.
    """
    kind = F.coalesce("artifact_kind", "technology")
    spoken = F.when(kind == "oracle", "plsql").when(kind == "powerbuilder", "powerscript")
    path = F.replace(F.coalesce("relative_path", F.lit("")), F.lit("\\"), F.lit("/"))
    out = symbols
    for column, value in ((kind, artifact_kind), (spoken, language), (F.col("document_id"), document_id)):
        if value is not None:
            out = out.filter(F.coalesce(column == value, F.lit(False)))
    if folder is not None:
        out = out.filter(F.startswith(T.folder_of(path), F.lit(folder.rstrip("/"))))
    if extension is not None:
        out = out.filter(F.endswith(F.lower(path), F.lit(extension.lower())))
    return out


MODES = ("semantic", "keyword", "hybrid")


def search(chunks: DataFrame, vectors: DataFrame | None, tokens: list[str], query: list[float] | None, mode: str = "hybrid", top_k: int = 10, candidate_k: int = 50, threshold: float = 0.0,
           vector_weight: float = 0.6, keyword_weight: float = 0.4, defer_top_k: bool = False) -> DataFrame:
    """Search as a service: candidates (chunk_id, vector_score, keyword_score, combined_score, rank, status) of one mode, with rank from 0.

    Each channel finds its ``candidate_k``; ``defer_top_k`` keeps as many, for a later selection. Without an index (``vectors`` or ``query`` None) the vector side is empty. Nothing found is one row
    without a chunk and status insufficient_evidence; else the status is completed.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    limit = candidate_k if defer_top_k else top_k
    kind = dict(chunks.dtypes)["chunk_id"]
    spark = chunks.sparkSession
    none = spark.createDataFrame([], f"chunk_id {kind}, score double")
    near = vector_search(vectors, query, candidate_k, threshold).select("chunk_id", "score") if mode != "keyword" and vectors is not None and query is not None else none
    said = keyword_search(chunks, tokens, candidate_k).select("chunk_id", "score") if mode != "semantic" else none
    if mode == "hybrid":
        found = hybrid_fusion(near, said, vector_weight, keyword_weight, limit, threshold)
    else:
        one = (near if mode == "semantic" else said).filter(F.col("score") >= threshold)
        columns = [F.when(F.lit(mode == m), F.col("score")).alias(f"{c}_score") for m, c in (("semantic", "vector"), ("keyword", "keyword"))]
        # a keyword search's own order has the path before the id
        order = [F.desc("combined_score"), "relative_path", "ordinal", "chunk_id"] if mode == "keyword" else [F.desc("combined_score"), "chunk_id"]
        found = one.select("chunk_id", *columns, F.col("score").alias("combined_score"))
        if mode == "keyword":
            found = found.join(chunks.select("chunk_id", "relative_path", "ordinal"), "chunk_id")
        found = found.orderBy(*order).limit(limit).select("chunk_id", "vector_score", "keyword_score", "combined_score", *([] if mode == "semantic" else ["relative_path", "ordinal"]))
    # at most ``limit`` rows are numbered here
    names = [c for c in ("relative_path", "ordinal") if c in found.columns]
    rank = F.row_number().over(Window.orderBy(F.desc("combined_score"), *names, "chunk_id")) - 1
    found = found.withColumn("rank", rank).select("chunk_id", "vector_score", "keyword_score", "combined_score", "rank")
    status = spark.range(1).select(F.lit(True).alias("_one"))
    joined = status.join(found.withColumn("_one", F.lit(True)), "_one", "left")
    return joined.select(*found.columns, F.when(F.col("chunk_id").isNull(), "insufficient_evidence").otherwise("completed").alias("status"))

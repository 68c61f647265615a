"""Which candidates of a search go into an answer's context: families, relevance first, budgets, and their metrics.

A query's candidates are rows without texts; every rule is a window or an aggregation over them, so no query is collected into one Python task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import text as T

#: Families of candidates in order of precedence.
FAMILIES = ("structured", "graph", "chunks")
#: Candidates that a task sorts, on average.
TASK_ROWS = 250_000


def _precedence(family: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, FAMILIES)), family)


def merge_chunks(candidates: DataFrame) -> DataFrame:
    """One candidate for each chunk of a query: (query_id, chunk_id, family, position, score, vector_score, keyword_score, origins).

    candidates: query_id, chunk_id, family, position (in its family), score, vector_score, keyword_score, origins (array). The first one by family and position gives family and position,
    scores are the greatest, and origins are all of them, each once, in that order. Families other than the three come last.
    """
    place = F.when(_precedence(F.col("family")) == 0, len(FAMILIES) + 1).otherwise(_precedence(F.col("family")))
    rows = candidates.withColumn("_at", F.struct(place.alias("f"), "position"))
    merged = rows.groupBy("query_id", "chunk_id").agg(
        F.min_by("family", "_at").alias("family"), F.min("_at").alias("_at"), *[F.max(c).alias(c) for c in ("score", "vector_score", "keyword_score")],
        F.array_sort(F.collect_list(F.struct("_at", "origins"))).alias("_o"),
    )
    origins = F.array_distinct(F.flatten(F.transform(F.filter("_o", lambda x: x["origins"].isNotNull()), lambda x: x["origins"])))
    return merged.select("query_id", "chunk_id", "family", F.col("_at.position").alias("position"), "score", "vector_score", "keyword_score", origins.alias("origins"))


def _shadowed(candidates: DataFrame) -> Column:
    """A raw chunk of a configuration, where the query has structured evidence."""
    has = F.max(((F.col("family") == "structured") & F.col("structured_symbol")).cast("int")).over(Window.partitionBy("query_id"))
    return (has == 1) & F.coalesce(F.col("artifact_kind") == "configuration", F.lit(False)) & ~F.col("structured_symbol")


def merge_first(candidates: DataFrame, limit: int, rows: int | None = None) -> DataFrame:
    """The first ``limit`` different chunks of each query, structured ones first, each family in its own order, with rank from 0.

    candidates: query_id, chunk_id, family, position, artifact_kind, structured_symbol. Raw configuration chunks go where there is structured evidence. ``rows``: about how many candidates there are (None: they are counted).
    Queries are dealt over tasks that grow in number with the candidates, once for all that follows, so that a task's sorts stay of one size.
    """
    rows = candidates.count() if rows is None else rows
    candidates = candidates.repartition(max(rows // TASK_ROWS + 1, candidates.sparkSession.sparkContext.defaultParallelism), "query_id")
    kept = candidates.withColumn("_shadowed", _shadowed(candidates)).filter(~F.col("_shadowed"))
    first = kept.groupBy("query_id", "chunk_id").agg(F.min(F.struct(_precedence(F.col("family")).alias("f"), "position", "family")).alias("_at"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("_at.f", "_at.position", "chunk_id")) - 1
    return first.withColumn("rank", rank).filter(F.col("rank") < limit).select("query_id", "chunk_id", F.col("_at.family").alias("family"), F.col("_at.position").alias("position"), "rank")


def select_by_relevance(candidates: DataFrame, limit: int, hash_prefix: int = 64) -> DataFrame:
    """A decision on every candidate: adds level, relevance, global_rank, action and reason (columns of these names are replaced).

    candidates: query_id, chunk_id, family (structured or chunks), position, score, exact (names what was asked), sha256, has_content, artifact_kind, structured_symbol. A chunk's hash follows from its id.
    Shadowed and empty candidates are omitted unranked. In each family, equal (exact, score) are a level, and relevance falls evenly from 1 at the first to 0 at the last. All are ranked by relevance, exact,
    family, chunk and position; a content's first candidate is selected while there is room, later ones are duplicates of it, and what comes after the limit says top_k.
    """
    structured_first = F.when(F.col("family") == "structured", 0).otherwise(1)
    rows = candidates.withColumn("_out", F.when(_shadowed(candidates), "shadowed_configuration").when(~F.coalesce("has_content", F.lit(False)), "missing_content"))
    exact = F.coalesce(F.col("exact"), F.lit(False)) & (F.col("family") == "structured")
    rows = rows.withColumn("exact", exact).withColumn("_index", F.struct(structured_first.alias("s"), "position"))
    kept = [c for c in candidates.columns if c not in ("level", "relevance", "global_rank", "action", "reason")]
    unranked = [F.lit(None).cast(kind).alias(c) for c, kind in (("level", "int"), ("relevance", "double"), ("global_rank", "int"))]
    out = rows.filter("_out is not null").select(*kept, *unranked, F.lit("omitted").alias("action"), F.col("_out").alias("reason"))
    family = Window.partitionBy("query_id", "family")
    ranked = rows.filter("_out is null").withColumn("level", F.dense_rank().over(family.orderBy(F.desc("exact"), F.desc("score"))) - 1)
    ranked = ranked.withColumn("_last", F.max("level").over(family))
    ranked = ranked.withColumn("relevance", F.when(F.col("_last") == 0, F.lit(1.0)).otherwise(1.0 - F.col("level") / F.nullif(F.col("_last"), F.lit(0))))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.desc("exact"), F.desc("_index.s"), "chunk_id", "_index")
    ranked = ranked.withColumn("global_rank", F.row_number().over(order) - 1).withColumn("_content", F.substring("sha256", 1, hash_prefix))
    content = Window.partitionBy("query_id", "_content").orderBy("global_rank")
    ranked = ranked.withColumns({"_first": F.row_number().over(content) == 1, "_holder": F.first("chunk_id").over(content)})
    # the number of contents before a content's first candidate says whether there was room for it
    ranked = ranked.withColumn("_before", F.sum(F.col("_first").cast("int")).over(Window.partitionBy("query_id").orderBy("global_rank")) - F.col("_first").cast("int"))
    ranked = ranked.withColumn("_room", F.first("_before").over(content) < limit)
    reason = F.when(~F.col("_room"), "top_k").when(F.col("_first"), "relevance").when(F.col("chunk_id") == F.col("_holder"), "duplicate_chunk_id").otherwise("duplicate_content")
    ranked = ranked.withColumn("reason", reason).withColumn("action", F.when(F.col("reason") == "relevance", "selected").otherwise("omitted"))
    return out.unionByName(ranked.select(*out.columns))


def fit_to_budget(sources: DataFrame, budget: int) -> DataFrame:
    """The same sources with their contents cut in proportion to fit ``budget`` tokens: (query_id, source, allocated, content).

    sources: query_id, source (its number), content. Each source has one token, the rest is shared by what each has beyond that, whole parts first, then one each by the greatest fraction. A query with
    fewer tokens than sources has no rows. The shares are windows over sizes; the contents are cut in place.
    """
    query = Window.partitionBy("query_id")
    rows = sources.withColumn("_weight", T.estimate_tokens(F.col("content")))
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(query), "_capacity": F.sum(F.col("_weight") - 1).over(query)}).filter(F.col("_n") <= budget)
    raw = F.coalesce((budget - F.col("_n")) * (F.col("_weight") - 1) / F.nullif(F.col("_capacity"), F.lit(0)), F.lit(0.0))
    rows = rows.withColumn("_raw", raw).withColumn("_extra", F.least(F.col("_weight") - 1, F.floor("_raw")))
    rows = rows.withColumn("_left", budget - F.col("_n") - F.sum("_extra").over(query)).withColumn("_room", F.col("_extra") + 1 < F.col("_weight"))
    rank = F.row_number().over(Window.partitionBy("query_id", "_room").orderBy(F.desc(F.col("_raw") - F.floor("_raw")), "source"))
    allocated = 1 + F.col("_extra") + (F.col("_room") & (rank <= F.col("_left"))).cast("long")
    return rows.withColumn("allocated", allocated).select("query_id", "source", "allocated", T.truncate_to_tokens(F.col("content"), F.col("allocated")).alias("content"))


def context_metrics(decisions: DataFrame, budget: int) -> DataFrame:
    """Of each query: candidates, selected, recall (selected of the candidates), duplicate_ratio, used tokens and token_waste. In: query_id, action, reason, tokens (of the selected)."""
    taken = F.col("action") == "selected"
    counted = decisions.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(taken).alias("selected"), F.count_if(F.col("reason").startswith("duplicate")).alias("_twice"), F.coalesce(F.sum(F.when(taken, F.col("tokens"))), F.lit(0)).alias("used"),
    )
    waste = F.greatest(F.lit(0), budget - F.col("used")) / F.lit(float(budget)) if budget else F.lit(0.0)
    return counted.select("query_id", "candidates", "selected", (F.col("selected") / F.col("candidates")).alias("recall"), (F.col("_twice") / F.col("candidates")).alias("duplicate_ratio"), "used", waste.alias("token_waste"))


def redundancy(candidates: DataFrame, hash_prefix: int = 64) -> DataFrame:
    """Of each query: candidates that repeat an earlier one's chunk or content, and the characters and tokens that leaving them out saves.

    In: query_id, chunk_id, rank, sha256, content. Contents are measured first; what is ranked are their sizes.
    """
    sized = candidates.select("query_id", "chunk_id", "rank", F.substring("sha256", 1, hash_prefix).alias("_c"), F.char_length("content").alias("chars"), T.estimate_tokens(F.col("content")).alias("tokens"))
    nth = lambda key: F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank", "chunk_id"))
    kinds = sized.withColumns({"_chunk": nth("chunk_id") > 1, "_content": nth("_c") > 1})
    twice = F.col("_chunk") | F.col("_content")
    total = lambda c: F.coalesce(F.sum(F.when(twice, F.col(c))), F.lit(0))
    return kinds.groupBy("query_id").agg(
        F.count_if("_chunk").alias("duplicate_chunks"), F.count_if(F.col("_content") & ~F.col("_chunk")).alias("duplicate_contents"), total("chars").cast("long").alias("avoided_chars"), total("tokens").alias("avoided_tokens"),
    )

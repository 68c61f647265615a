"""Whole prompts within a budget of tokens: which sources fit, and an exchange for a graph's evidence where the budget left all of it out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.plans.materialize import written

LEAST_TOKENS = 8


def fit_prompts(sources: DataFrame, overheads: DataFrame, budget: int, least_tokens: int = LEAST_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The largest part of each query's sources whose whole prompt is estimated at ``budget`` tokens at most: (sources with chars_sent and decision, a row per query).

    sources: query_id, rank (their order, unique in a query), head_chars and content_chars (what a source's heading and content take), and others, which are kept. overheads: query_id, overhead_chars (instructions, question and format), one row a query. A prompt's
    tokens are a quarter of its characters, rounded up. Sources are taken whole in order while the prompt fits (``selected``); the first that does not is cut to what is left if that is ``least_tokens`` or more (``cut``); the rest say ``budget``.

    Queries: query_id, n_sources (sent), prompt_tokens, evidence_budget (what the overhead leaves) and result: fits, insufficient_evidence (no source is sent) or fixed_overhead_exceeds_budget. Queries without sources are in it.

    The prompt grows with each source, so a running sum of sizes tells how far it fits, for all queries at once: nothing is rendered, and no content is moved. A query's sources are a search's top rows.
    """
    room = 4 * budget
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = sources.join(overheads.select("query_id", "overhead_chars"), "query_id")
    rows = rows.withColumn("_until", F.col("overhead_chars") + F.sum(F.col("head_chars") + F.col("content_chars")).over(order))
    rows = rows.withColumn("_fits", F.col("_until") <= room)
    first = F.row_number().over(Window.partitionBy("query_id", "_fits").orderBy("rank")) == 1
    left = F.floor((room - F.col("_until") + F.col("content_chars")) / 4)
    cut = ~F.col("_fits") & first & (left >= least_tokens)
    rows = rows.withColumn("decision", F.when(F.col("_fits"), "selected").when(cut, "cut").otherwise("budget"))
    sent = F.when(F.col("decision") == "selected", F.col("content_chars")).when(F.col("decision") == "cut", F.least(F.col("content_chars"), 4 * left)).otherwise(0)
    rows = rows.withColumn("chars_sent", sent.cast("long"))
    used = rows.filter("decision != 'budget'").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"), F.sum(F.col("head_chars") + F.col("chars_sent")).alias("_chars"))
    told = overheads.select("query_id", "overhead_chars").join(used, "query_id", "left")
    tokens = lambda chars: F.ceil(chars / 4)
    over = tokens(F.col("overhead_chars")) > budget
    result = F.when(over, "fixed_overhead_exceeds_budget").when(F.col("n_sources").isNull(), "insufficient_evidence").otherwise("fits")
    queries = told.select(
        "query_id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), tokens(F.col("overhead_chars") + F.coalesce("_chars", F.lit(0))).cast("long").alias("prompt_tokens"),
        F.greatest(F.lit(0), budget - tokens(F.col("overhead_chars"))).cast("long").alias("evidence_budget"), result.alias("result"),
    )
    return rows.drop("_until", "_fits", "overhead_chars"), queries


def exchange_for_graph(sources: DataFrame, overheads: DataFrame, budget: int, least_tokens: int = LEAST_TOKENS) -> tuple[DataFrame, DataFrame]:
    """fit_prompts(), and where it sends none of a query's graph candidates for want of budget, one exchange: the best omitted one takes the place of the worst source sent.

    sources: as in fit_prompts(), with chunk_id, content_key, and is_graph. The exchange stands if the prompt that it makes has the graph's candidate, as many sources as before, and no chunk or content twice; else nothing changes. Sources: with decision and chars_sent, the
    one that went says ``budget_fallback``. Queries: query_id, triggered, applied, candidate_rank, replaced_rank.

    The sources are fitted once and written, as are the queries with an exchange and what it makes of them: each is read several times.
    """
    fitted, _ = fit_prompts(sources, overheads, budget, least_tokens)
    fitted = written(fitted, "fitted")
    sent = F.col("decision").isin("selected", "cut")
    graph = fitted.groupBy("query_id").agg(
        F.max((F.col("is_graph") & sent).cast("int")).alias("_has"), F.min(F.when(F.col("is_graph") & (F.col("decision") == "budget"), F.struct("rank", "chunk_id"))).alias("_in"),
        F.max(F.when(sent, F.struct("rank", "chunk_id"))).alias("_out"),
    )
    triggered = graph.filter((F.col("_has") == 0) & F.col("_in").isNotNull() & F.col("_out").isNotNull()).select("query_id", F.col("_in.rank").alias("candidate_rank"), F.col("_out.rank").alias("replaced_rank"))
    triggered = written(triggered, "triggered")
    marked = fitted.join(triggered, "query_id").drop("decision", "chars_sent")
    before = fitted.filter(sent).join(triggered.select("query_id"), "query_id", "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("_before"))
    # the candidate stands where the source stood that it replaces
    kept = fitted.filter(sent).select("query_id", "rank").withColumn("_sent", F.lit(True))
    chosen = marked.join(kept, ["query_id", "rank"], "left").filter((F.col("_sent") & (F.col("rank") != F.col("replaced_rank"))) | (F.col("rank") == F.col("candidate_rank")))
    tried = chosen.withColumn("_own", F.col("rank")).withColumn("rank", F.when(F.col("rank") == F.col("candidate_rank"), F.col("replaced_rank")).otherwise(F.col("rank"))).drop("_sent")
    again = written(fit_prompts(tried, overheads, budget, least_tokens)[0], "exchanged")
    good = again.filter(sent).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("chunk_id").alias("_chunks"), F.count_distinct("content_key").alias("_contents"), F.max((F.col("_own") == F.col("candidate_rank")).cast("int")).alias("_there")
    )
    stands = good.join(before, "query_id").filter((F.col("_there") == 1) & (F.col("_n") >= F.col("_before")) & (F.col("_chunks") == F.col("_n")) & (F.col("_contents") == F.col("_n"))).select("query_id", F.lit(True).alias("_applied"))
    new = again.filter(sent).select("query_id", F.col("_own").alias("rank"), F.col("decision").alias("_new"), F.col("chars_sent").alias("_sent"))
    out = fitted.join(stands, "query_id", "left").join(triggered.select("query_id", "replaced_rank"), "query_id", "left").join(new, ["query_id", "rank"], "left")
    swapped = F.coalesce(F.col("_applied"), F.lit(False))
    gone = F.when(F.col("rank") == F.col("replaced_rank"), "budget_fallback").otherwise("budget")
    out = out.withColumns({"decision": F.when(swapped, F.coalesce("_new", gone)).otherwise(F.col("decision")), "chars_sent": F.when(swapped, F.coalesce("_sent", F.lit(0))).otherwise(F.col("chars_sent"))}).drop("_applied", "_new", "_sent", "replaced_rank")
    report = overheads.select("query_id").join(triggered, "query_id", "left").join(stands, "query_id", "left")
    report = report.select("query_id", F.col("candidate_rank").isNotNull().alias("triggered"), F.coalesce("_applied", F.lit(False)).alias("applied"), "candidate_rank", "replaced_rank")
    return out, report

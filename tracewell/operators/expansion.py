"""Expansion of a search's seeds over the graph, breadth first, with limits that hold over all levels and seeds of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.operators.graph import adjacent
from tracewell.plans.materialize import written

_TRACE = ["query_id", "seed_rank", "seed_id", "depth", "place", "source", "target", "relation_id", "status", "path", "relations"]


def expand_levels(edges: DataFrame, symbols: DataFrame, seeds: DataFrame, most_depth: int = 2, most_seeds: int = 4, most_neighbours: int = 6, most_candidates: int = 8, direction: str = "outgoing",
                  relation_types: list[str] | None = None, least_confidence: str | None = None, domain: str | None = None) -> DataFrame:
    """What is tried from each query's seeds, in order: (query_id, seed_rank, seed_id, depth, place, source, target, relation_id, status, path, relations).

    edges, symbols: as in adjacent(), symbols with ``status``. seeds: query_id, seed_id, node (null: none), score. Seeds go by score, then id; ``seed_rank`` from 1. Statuses: accepted; duplicate (a symbol that the query has
    accepted before); cycle (one of its own path); unresolved_source (a relation or seed without an active symbol); limit: a seed beyond ``most_seeds``, the first relation of each path that comes after the seed's
    ``most_neighbours`` relations, or the first new symbol beyond the query's ``most_candidates``, which ends the query. Only accepted symbols lead on.

    A query's seeds are taken one after another and each seed level by level, for all queries at once: a level is one join of the frontier with the relations, whose rows are numbered in the order in which
    a queue would take them; prefix sums of that order say which are within the limits. At most ``most_seeds * most_depth`` levels of at most ``most_neighbours`` rows and one per path a query are written.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seed_id")
    ranked = seeds.select("query_id", "seed_id", "node", "score").withColumn("seed_rank", F.row_number().over(order))
    active = symbols.filter("status = 'active'").select(F.col("symbol_id").alias("node"), F.lit(True).alias("_active")).distinct()
    none = F.array().cast("array<string>")
    ranked = written(ranked.join(active, "node", "left"), "seeds")
    status = F.when(F.col("seed_rank") > most_seeds, "limit").when(F.col("_active").isNull(), "unresolved_source")
    told = ranked.withColumn("status", status).filter("status is not null")
    kind = dict(symbols.dtypes)["symbol_id"]
    nothing = F.lit(None).cast(kind)
    out = told.select("query_id", "seed_rank", "seed_id", F.lit(0).alias("depth"), F.lit(0).alias("place"), nothing.alias("source"), F.col("node").cast(kind).alias("target"), F.lit(None).cast("string").alias("relation_id"),
                      "status", F.array().cast(f"array<{kind}>").alias("path"), none.alias("relations"))
    steps = adjacent(edges, symbols, edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node"))).filter("node is not null"), direction, relation_types, None, least_confidence, None, domain)
    steps = steps.join(active.select(F.col("node").alias("neighbour"), F.lit(True).alias("_there")), "neighbour", "left")
    steps = written(steps.select("node", "neighbour", F.col("relation_id").cast("string").alias("relation_id"), "position", F.coalesce("_there", F.lit(False)).alias("_there")), "steps")

    accepted = ranked.select("query_id", F.col("node").cast(kind).alias("neighbour")).limit(0)
    stopped = ranked.select("query_id").limit(0)
    for rank in range(1, most_seeds + 1):
        roots = ranked.filter((F.col("seed_rank") == rank) & F.col("_active")).join(stopped, "query_id", "left_anti")
        frontier = roots.select("query_id", "seed_rank", "seed_id", "node", F.lit(1).alias("_at"), F.lit(0).cast("long").alias("_tried"), F.array(F.col("node").cast(kind)).alias("path"), none.alias("relations"))
        for depth in range(1, most_depth + 1):
            level = written(_level(frontier, steps, accepted, most_neighbours, most_candidates).withColumn("depth", F.lit(depth)), "expansion")
            new = level.filter("status = 'accepted'")
            accepted = accepted.unionByName(new.select("query_id", F.col("target").alias("neighbour")))
            stopped = stopped.unionByName(level.filter("_stops").select("query_id"))
            out = out.unionByName(level.select(*_TRACE))
            tried = level.groupBy("query_id").agg(F.max("_sofar").alias("_tried"))
            onward = new.join(stopped, "query_id", "left_anti").join(tried, "query_id")
            frontier = onward.select("query_id", "seed_rank", "seed_id", F.col("target").alias("node"), F.col("place").alias("_at"), "_tried", F.concat("path", F.array("target")).alias("path"), F.concat("relations", F.array("relation_id")).alias("relations"))
    return out


def _level(frontier: DataFrame, steps: DataFrame, accepted: DataFrame, most_neighbours: int, most_candidates: int) -> DataFrame:
    """One level of a seed of all queries: its rows with their statuses, and whether a row ends its query."""
    query = Window.partitionBy("query_id")
    sofar = query.orderBy("_at", "position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = frontier.join(steps, "node").withColumn("place", F.row_number().over(query.orderBy("_at", "position")).cast("int"))
    rows = rows.withColumn("_sofar", F.col("_tried") + F.col("place"))
    over = F.col("_sofar") > most_neighbours
    # of the relations beyond the limit each path tells its first
    rows = rows.withColumn("_over", over).withColumn("_nth", F.row_number().over(Window.partitionBy("query_id", "_at", "_over").orderBy("position"))).filter(~F.col("_over") | (F.col("_nth") == 1))
    before = accepted.groupBy("query_id").agg(F.count(F.lit(1)).alias("_before"))
    rows = rows.join(accepted.withColumn("_known", F.lit(True)), ["query_id", "neighbour"], "left").join(before, "query_id", "left")
    lost = F.col("neighbour").isNull()
    cycle = F.coalesce(F.array_contains("path", F.col("neighbour")), F.lit(False))
    fits = ~F.col("_over") & ~lost & ~cycle & F.col("_there")
    rows = rows.withColumn("_fits", fits)
    first = F.row_number().over(Window.partitionBy("query_id", "neighbour", "_fits").orderBy("_at", "position")) == 1
    rows = rows.withColumn("_new", F.col("_fits") & F.col("_known").isNull() & first)
    rows = rows.withColumn("_count", F.coalesce("_before", F.lit(0)) + F.sum(F.col("_new").cast("int")).over(sofar))
    rows = rows.withColumn("_stops", F.col("_new") & (F.col("_count") == most_candidates + 1))
    # what comes after the row that ends a query is not tried
    rows = rows.withColumn("_ended", F.coalesce(F.sum(F.col("_stops").cast("int")).over(query.orderBy("_at", "position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("_ended = 0")
    status = (
        F.when(F.col("_over") | F.col("_stops"), "limit").when(lost, "unresolved_source").when(cycle, "cycle").when(~F.col("_there"), "unresolved_source").when(F.col("_new"), "accepted").otherwise("duplicate")
    )
    # relations beyond the limit don't count as tried
    counted = F.least(F.col("_sofar"), F.lit(most_neighbours))
    return rows.select(
        "query_id", "seed_rank", "seed_id", "place", F.col("node").alias("source"), F.col("neighbour").alias("target"), "relation_id", status.alias("status"), "path", "relations", counted.alias("_sofar"), "_stops"
    )


def resolved_chunks(traces: DataFrame, seeds: DataFrame, holders: DataFrame, decay: float = 0.95) -> DataFrame:
    """The chunk of each symbol that traces accepted or met again: (query_id, chunk_id, symbol_id, score, seeds), one a symbol, best first by score and chunk.

    holders: symbol_id, chunk_id, the chunk that shows it. The score is the greatest of its traces' seeds' scores times ``decay`` for each step; seeds are the ids of all of them, sorted.
    """
    kept = traces.filter(F.col("status").isin("accepted", "duplicate") & (F.col("depth") > 0))
    scored = kept.join(seeds.select("query_id", "seed_id", F.col("score").alias("_s")), ["query_id", "seed_id"])
    best = scored.groupBy("query_id", F.col("target").alias("symbol_id")).agg(F.max(F.col("_s") * F.pow(F.lit(decay), F.col("depth"))).alias("score"), F.sort_array(F.collect_set("seed_id")).alias("seeds"))
    return best.join(holders.select("symbol_id", "chunk_id"), "symbol_id").select("query_id", "chunk_id", "symbol_id", "score", "seeds")

"""The dependency graph: walks, impact, expansion, patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.plans.materialize import written

DIRECTIONS = ("outgoing", "incoming", "both")
MOST_DEPTH = 5


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (node, neighbour, relation_id, relation_type, direction)."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "relation_id", "relation_type", F.lit("outgoing").alias("direction"))
    back = edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "relation_id", "relation_type", F.lit("incoming").alias("direction"))
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]


def walk(edges: DataFrame, seeds: DataFrame, direction: str = "outgoing", most_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Breadth-first from the seeds: nodes (node, depth) and edges (node, neighbour, relation_id, relation_type, direction, depth, is_new).

    edges: source, target, relation_id, relation_type. seeds: node. Every level is one join of the frontier with the
    edges, at most five of them, and is written, so that no level computes the earlier ones again; is_new says that the
    edge's end was first reached over this level.
    """
    if not 0 <= most_depth <= MOST_DEPTH:
        raise ValueError(f"depth must be 0 to {MOST_DEPTH}")
    steps = directed(edges, direction)
    nodes = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    walked = None
    for depth in range(1, most_depth + 1):
        frontier = nodes.filter(F.col("depth") == depth - 1).select("node")
        reached = steps.join(frontier, "node").withColumn("depth", F.lit(depth))
        known = nodes.select(F.col("node").alias("neighbour"), F.lit(True).alias("_known"))
        level = reached.join(known, "neighbour", "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")
        level = written(level.select("node", "neighbour", "relation_id", "relation_type", "direction", "depth", "is_new"), "walk")
        nodes = nodes.unionByName(level.filter("is_new").select(F.col("neighbour").alias("node"), "depth").distinct())
        walked = level if walked is None else walked.unionByName(level)
    if walked is None:
        walked = steps.withColumns({"depth": F.lit(0), "is_new": F.lit(False)}).limit(0)
    return nodes, walked


def traced_walk(edges: DataFrame, seeds: DataFrame, direction: str = "outgoing", most_depth: int = 3, node_limit: int | None = None, relation_types: list[str] | None = None, technologies: list[str] | None = None) -> DataFrame:
    """Breadth-first traces from each seed: rows (root, depth, source, target, relation_id, relation_type, status, path, is_cycle).

    edges: source, target (null if unresolved), relation_id, relation_type, resolution_status, technology (of the relation), target_key. seeds: root, a query each.
    status is ``accepted`` for an edge to a new node, ``duplicate`` for one to a node that the root reached before, ``cycle`` for one back to a node of its own path,
    ``unresolved`` or ``ambiguous`` for a leaf that names no node, and ``limit`` for a new node beyond ``node_limit`` of its root, in order of depth, relation type and id.

    Every level is one join of the frontier with the edges and is written. A path has at most five nodes; a root's nodes are a table, never a list in a row.
    """
    if not 0 <= most_depth <= MOST_DEPTH:
        raise ValueError(f"depth must be 0 to {MOST_DEPTH}")
    kept = edges
    for column, allowed in (("relation_type", relation_types), ("technology", technologies)):
        if allowed is not None:
            kept = kept.filter(F.col(column).isin(*allowed))
    ways = []
    if direction in ("outgoing", "both"):
        ways.append(kept.select(F.col("source").alias("node"), F.col("target").alias("next"), "relation_id", "relation_type", "resolution_status", "target_key"))
    if direction in ("incoming", "both"):
        ways.append(kept.filter("target is not null").select(F.col("target").alias("node"), F.col("source").alias("next"), "relation_id", "relation_type", "resolution_status", "target_key"))
    if not ways:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    steps = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    frontier = seeds.select("root").distinct().select("root", F.col("root").alias("node"), F.array("root").alias("path"))
    known = frontier.select("root", "node")
    out = None
    for depth in range(1, most_depth + 1):
        level = frontier.join(steps, "node").withColumn("depth", F.lit(depth))
        seen = known.select("root", F.col("node").alias("next"), F.lit(True).alias("_seen"))
        level = level.join(seen, ["root", "next"], "left")
        first = Window.partitionBy("root", "next").orderBy("relation_type", "relation_id", "node")
        leaf = F.col("next").isNull()
        cycle = ~leaf & F.array_contains("path", F.col("next"))
        fresh = ~leaf & F.col("_seen").isNull() & (F.row_number().over(first) == 1)
        status = F.when(leaf, F.when(F.col("resolution_status") == "ambiguous", "ambiguous").otherwise("unresolved")).when(cycle, "cycle").when(fresh, "accepted").otherwise("duplicate")
        level = level.withColumn("status", status)
        if node_limit is not None:
            # how many new nodes a root has before this level, and before this row in it
            before = known.groupBy("root").agg((F.count(F.lit(1)) - 1).alias("_before"))
            order = Window.partitionBy("root").orderBy("relation_type", "relation_id", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            level = level.join(before, "root").withColumn("_nth", F.sum((F.col("status") == "accepted").cast("int")).over(order) + F.col("_before"))
            level = level.withColumn("status", F.when((F.col("status") == "accepted") & (F.col("_nth") > node_limit), "limit").otherwise(F.col("status")))
        level = written(level.select("root", "depth", "node", "next", "relation_id", "relation_type", "target_key", "status", "path"), "traces")
        new = level.filter("status = 'accepted'")
        frontier = new.select("root", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        known = known.unionByName(new.select("root", F.col("next").alias("node")))
        out = level if out is None else out.unionByName(level)
    if out is None:
        out = frontier.join(steps, "node").withColumns({"depth": F.lit(0), "status": F.lit("accepted")}).limit(0)
    return out.select("root", "depth", F.col("node").alias("source"), F.col("next").alias("target"), "relation_id", "relation_type", "target_key", "status", "path", (F.col("status") == "cycle").alias("is_cycle"))


def cycles_of(traces: DataFrame) -> DataFrame:
    """The cycles that traces close: (root, cycle), the nodes from the one that is met again, rotated to start at the least, each once."""
    closed = traces.filter("is_cycle").select("root", F.slice("path", F.array_position("path", F.col("target")).cast("int"), F.size("path")).alias("c"))
    at = F.array_position("c", F.array_min("c")).cast("int")
    turned = F.concat(F.slice("c", at, F.size("c")), F.slice("c", 1, at - 1))
    return closed.select("root", turned.alias("cycle")).distinct()


def traced_chunks(traces: DataFrame, evidence: DataFrame, fallback: DataFrame, decay: float = 0.95) -> DataFrame:
    """Chunks for accepted traces: (root, chunk_id, score, depth), the score falling by ``decay`` a step, the best for each chunk.

    evidence: relation_id, chunk_id. fallback: node, chunk_id, taken for a target whose relation has no evidence chunk.
    """
    taken = traces.filter("status = 'accepted'").select("root", "relation_id", F.col("target").alias("node"), "depth")
    shown = taken.join(evidence.select("relation_id", "chunk_id"), "relation_id", "left")
    by_node = shown.filter("chunk_id is null").drop("chunk_id").join(fallback.select("node", "chunk_id"), "node")
    both = shown.filter("chunk_id is not null").select("root", "chunk_id", "depth").unionByName(by_node.select("root", "chunk_id", "depth"))
    return both.groupBy("root", "chunk_id").agg(F.min("depth").alias("depth")).withColumn("score", F.pow(F.lit(decay), F.col("depth")))


def impact_report(traces: DataFrame, symbols: DataFrame) -> DataFrame:
    """By root: nodes reached, those of another technology than the root's, unresolved, ambiguous and cyclic edges, and the risk: high with cycles or over ten nodes of another technology,
    medium with any open edge or another technology, else low. symbols: symbol_id, technology."""
    kinds = symbols.select("symbol_id", "technology")
    rows = traces.join(kinds.select(F.col("symbol_id").alias("root"), F.col("technology").alias("_own")), "root", "left").join(kinds.select(F.col("symbol_id").alias("target"), "technology"), "target", "left")
    is_ = lambda s: F.count_if(F.col("status") == s)
    out = rows.groupBy("root").agg(
        is_("accepted").alias("nodes"), F.count_if((F.col("status") == "accepted") & (F.col("technology") != F.col("_own"))).alias("cross_technology"),
        is_("unresolved").alias("unresolved"), is_("ambiguous").alias("ambiguous"), is_("cycle").alias("cycles"),
    )
    risk = F.when((F.col("cycles") > 0) | (F.col("cross_technology") > 10), "high").when(F.col("unresolved") + F.col("ambiguous") + F.col("cross_technology") > 0, "medium").otherwise("low")
    return out.withColumn("risk", risk)


def impact(edges: DataFrame, seeds: DataFrame, most_depth: int = 2) -> DataFrame:
    """Who is concerned by a change of the seeds: role (consumer, dependency), node, depth, indirect."""
    parts = []
    for direction, role in (("incoming", "consumer"), ("outgoing", "dependency")):
        nodes, _ = walk(edges, seeds, direction, most_depth)
        parts.append(nodes.filter("depth > 0").select(F.lit(role).alias("role"), "node", "depth", (F.col("depth") > 1).alias("indirect")))
    return parts[0].unionByName(parts[1])


def decayed_scores(edges: DataFrame, seeds: DataFrame, most_depth: int = 2, decay: float = 0.95) -> DataFrame:
    """The best score of each node reached from scored seeds: the seed's, times ``decay`` for each step. seeds: node, score."""
    steps = directed(edges, "both").select("node", "neighbour").distinct()
    now = seeds.groupBy("node").agg(F.max("score").alias("score"))
    out = now
    for _ in range(most_depth):
        now = written(now.join(steps, "node").groupBy(F.col("neighbour").alias("node")).agg((F.max("score") * decay).alias("score")), "decay")
        out = out.unionByName(now)
    return out.groupBy("node").agg(F.max("score").alias("score"))


def expand(edges: DataFrame, seeds: DataFrame, most_seeds: int, most_neighbours: int, most_candidates: int) -> DataFrame:
    """One step from the best seeds, with limits for each query: rows (query_id, seed, neighbour, relation_id, status).

    seeds: query_id, node, score. The limits are the operator's: a query takes its ``most_seeds`` best seeds, each seed
    its first ``most_neighbours`` edges by type and id, and a query ``most_candidates`` new nodes; other edges say
    ``limit`` or ``duplicate``.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    roots = seeds.withColumn("_seed_rank", F.row_number().over(best)).filter(F.col("_seed_rank") <= most_seeds)
    joined = roots.join(directed(edges, "both"), "node")
    near = Window.partitionBy("query_id", "node").orderBy("relation_type", "relation_id", "direction")
    joined = joined.withColumn("_rank", F.row_number().over(near))
    taken = joined.filter(F.col("_rank") <= most_neighbours)
    over = joined.filter(F.col("_rank") == most_neighbours + 1).withColumn("status", F.lit("limit"))
    first = Window.partitionBy("query_id", "neighbour").orderBy("_seed_rank", "_rank")
    taken = taken.withColumn("_first", F.row_number().over(first) == 1)
    count = Window.partitionBy("query_id").orderBy("_seed_rank", "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = taken.withColumn("_count", F.sum(F.col("_first").cast("int")).over(count))
    status = F.when(~F.col("_first"), "duplicate").when(F.col("_count") > most_candidates, "limit").otherwise("accepted")
    columns = ["query_id", F.col("node").alias("seed"), "neighbour", "relation_id", "status"]
    return taken.withColumn("status", status).select(*columns).unionByName(over.select(*columns))


def eligible(relations: DataFrame, symbols: DataFrame, types: list[str]) -> DataFrame:
    """Active resolved relations of the given types whose two ends are active symbols."""
    active = symbols.filter("status = 'active'").select("symbol_id")
    out = relations.filter((F.col("status") == "active") & (F.col("resolution_status") == "resolved") & F.col("relation_type").isin(types))
    for end in ("source", "target"):
        out = out.join(active.select(F.col("symbol_id").alias(end)), end, "left_semi")
    return out


def component_reuse(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """For every symbol: distinct sources that point to it, edges, files they are in, repeats, and whether that says anything.

    symbols: symbol_id. edges: source, target, file_id, relation_type.
    """
    counted = edges.groupBy(F.col("target").alias("symbol_id")).agg(
        F.countDistinct("source").alias("distinct_sources"), F.count(F.lit(1)).alias("inbound"), F.countDistinct("file_id").alias("files")
    )
    out = symbols.select("symbol_id").join(counted, "symbol_id", "left").fillna(0)
    status = F.when(F.col("inbound") == 0, "insufficient_evidence").otherwise("not_evaluated")
    return out.withColumn("repeated", F.col("inbound") - F.col("distinct_sources")).withColumn("status", status)


def structural_centrality(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """For every symbol: distinct neighbours in both directions and in each, and edges in each."""
    ends = edges.select(F.col("target").alias("symbol_id"), F.col("source").alias("neighbour"), F.lit("in").alias("side")).unionByName(
        edges.select(F.col("source").alias("symbol_id"), F.col("target").alias("neighbour"), F.lit("out").alias("side"))
    )
    side = lambda s: F.when(F.col("side") == s, F.col("neighbour"))
    # the edges of a symbol and neighbour are counted first, so that distinct counting needs no expanding
    pairs = ends.groupBy("symbol_id", "neighbour").agg(F.count(side("in")).alias("_in"), F.count(side("out")).alias("_out"))
    counted = pairs.groupBy("symbol_id").agg(
        F.count(F.lit(1)).alias("neighbours"),
        F.count_if(F.col("_in") > 0).alias("neighbours_in"),
        F.count_if(F.col("_out") > 0).alias("neighbours_out"),
        F.sum("_in").alias("edges_in"),
        F.sum("_out").alias("edges_out"),
    )
    out = symbols.select("symbol_id").join(counted, "symbol_id", "left").fillna(0)
    return out.withColumn("status", F.when(F.col("neighbours") == 0, "insufficient_evidence").otherwise("not_evaluated"))


def type_histogram(edges: DataFrame, end: str) -> DataFrame:
    """Relations of each symbol by type, as a sorted array of (relation_type, n)."""
    counted = edges.groupBy(F.col(end).alias("symbol_id"), "relation_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("symbol_id").agg(F.sort_array(F.collect_list(F.struct("relation_type", "n"))).alias("types"))


#: Confidences from low to high.
CONFIDENCES = ("low", "medium", "high")


def adjacent(edges: DataFrame, symbols: DataFrame, nodes: DataFrame, direction: str = "outgoing", relation_types: list[str] | None = None, resolution_status: str | None = "resolved",
             least_confidence: str | None = None, technology: str | None = None, domain: str | None = None) -> DataFrame:
    """Active relations at each node, filtered: (node, neighbour, relation_id, relation_type, resolution_status, target_key, direction, position).

    edges: source, target (null if unresolved), relation_id, relation_type, resolution_status, confidence, status, target_key. symbols: symbol_id, technology, domain. nodes: node. An empty list of types
    gives nothing. ``technology`` must be that of either end that is known, ``domain`` that of the node and of every end that is known. position counts by type, status, target key and id.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    kept = edges.filter("status = 'active'")
    if relation_types is not None:
        kept = kept.filter(F.col("relation_type").isin(*relation_types)) if relation_types else kept.limit(0)
    if resolution_status is not None:
        kept = kept.filter(F.col("resolution_status") == resolution_status)
    if least_confidence is not None:
        kept = kept.filter(F.col("confidence").isin(*CONFIDENCES[CONFIDENCES.index(least_confidence) :]))
    ways = [kept.withColumns({"node": F.col("source"), "neighbour": F.col("target"), "direction": F.lit("outgoing")}), kept.filter("target is not null").withColumns({"node": F.col("target"), "neighbour": F.col("source"), "direction": F.lit("incoming")})]
    chosen = {"outgoing": ways[:1], "incoming": ways[1:], "both": ways}[direction]
    rows = chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])
    rows = rows.join(nodes.select("node").distinct(), "node", "left_semi")
    if technology is not None or domain is not None:
        of = lambda end: symbols.select(F.col("symbol_id").alias(end), F.col("technology").alias(f"_{end}_t"), F.col("domain").alias(f"_{end}_d"))
        rows = rows.join(of("node"), "node", "left").join(of("neighbour"), "neighbour", "left")
        same = lambda column, value: F.coalesce(F.col(column) == value, F.lit(False))
        if technology is not None:
            wanted = technology.strip().lower()
            rows = rows.filter(same("_node_t", wanted) | same("_neighbour_t", wanted))
        if domain is not None:
            rows = rows.filter(same("_node_d", domain) & F.coalesce(F.col("_neighbour_d") == domain, F.lit(True)))
    order = Window.partitionBy("node").orderBy("relation_type", "resolution_status", "target_key", "relation_id", "direction")
    return rows.withColumn("position", F.row_number().over(order)).select("node", "neighbour", "relation_id", "relation_type", "resolution_status", "target_key", "direction", "position")


def ordered_edges(traces: DataFrame, symbols: DataFrame) -> DataFrame:
    """Traces with their place in the output of their root: by depth, relation type, technology and name of the target (its key if it names no symbol), and id. symbols: symbol_id, technology, name."""
    named = traces.join(symbols.select(F.col("symbol_id").alias("target"), F.col("technology").alias("_t"), F.col("name").alias("_n")), "target", "left")
    order = Window.partitionBy("root").orderBy("depth", "relation_type", F.coalesce("_t", F.lit("")), F.coalesce("_n", "target_key", F.lit("")), "relation_id", "source")
    return named.withColumn("place", F.row_number().over(order)).drop("_t", "_n")


def top_patterns(rows: DataFrame, metric: str, name: str = "symbol_id", limit: int = 10) -> DataFrame:
    """The report of a pattern: symbols with evidence and a metric above 0, greatest first, then by name."""
    return rows.filter((F.col("status") != "insufficient_evidence") & (F.col(metric) > 0)).orderBy(F.desc(metric), name).limit(limit)

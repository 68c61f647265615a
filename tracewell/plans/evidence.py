"""Queries over candidates, answers and runs: selection for a context, budgets, search as a service, index runs, benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import vectors as V
from tracewell.operators import catalog, context, evaluation, graph, retrieval, runs, selection
from tracewell.plans import tables as P
from tracewell.plans.registry import query


def _position() -> Column:
    """The order of a line item; its part and supplier tell apart items of one number."""
    return (F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey") % 10000


def _candidates(spark, sf_dir: str) -> DataFrame:
    """Customers as queries, the items of their orders as candidates: parts are chunks, returned ones are structured evidence."""
    orders = P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("query_id"))
    parts = P.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.sha2(F.concat("p_brand", F.col("p_size").cast("string")), 256).alias("sha256"))
    rows = P.read(spark, sf_dir, "lineitem").join(orders, "l_orderkey").join(parts, "l_partkey")
    structured = F.col("l_returnflag") == "A"
    return rows.select(
        "query_id", F.col("l_partkey").alias("chunk_id"), F.when(structured, "structured").otherwise("chunks").alias("family"), _position().alias("position"),
        F.col("l_discount").alias("score"), (F.col("l_linenumber") == 1).alias("exact"), "sha256", (F.col("l_quantity") > 2).alias("has_content"),
        F.when(F.col("l_suppkey") % 7 == 0, "configuration").otherwise("text").alias("artifact_kind"), (structured & (F.col("l_suppkey") % 2 == 0)).alias("structured_symbol"), F.col("l_quantity").cast("long").alias("tokens"),
    )


_CANDIDATES = """c AS (
  SELECT o_custkey AS query_id, l_partkey AS chunk_id, CASE WHEN l_returnflag = 'A' THEN 'structured' ELSE 'chunks' END AS family, (l_orderkey * 100 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey % 10000 AS position, l_discount AS score,
    l_linenumber = 1 AND l_returnflag = 'A' AS exact, sha256(p_brand || p_size) AS sha256, l_quantity > 2 AS has_content, l_suppkey % 7 = 0 AS conf, l_returnflag = 'A' AND l_suppkey % 2 = 0 AS sym, l_quantity::BIGINT AS tokens
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
d AS (SELECT *, conf AND NOT sym AND max(sym::INT) OVER (PARTITION BY query_id) = 1 AS shadowed FROM c),
r AS (SELECT *, dense_rank() OVER (PARTITION BY query_id, family ORDER BY exact DESC, score DESC) - 1 AS level FROM d WHERE NOT shadowed AND has_content),
s AS (SELECT *, CASE WHEN max(level) OVER (PARTITION BY query_id, family) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - level / max(level) OVER (PARTITION BY query_id, family) END AS relevance FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, exact DESC, family, chunk_id, position) - 1 AS global_rank FROM s)"""
# the fold, one rank after another: what was selected so far is carried along
_FOLD = f"""WITH RECURSIVE {_CANDIDATES}, m AS MATERIALIZED (SELECT query_id, chunk_id, family, position, level, relevance, global_rank, sha256, tokens FROM g),
fold AS (
  SELECT query_id, -1::BIGINT AS global_rank, []::BIGINT[] AS chunks, []::VARCHAR[] AS hashes, '' AS reason FROM (SELECT DISTINCT query_id FROM m)
  UNION ALL
  SELECT query_id, rank, CASE WHEN reason = 'relevance' THEN list_append(chunks, chunk_id) ELSE chunks END, CASE WHEN reason = 'relevance' THEN list_append(hashes, sha256) ELSE hashes END, reason
  FROM (SELECT m.query_id, m.global_rank AS rank, chunks, hashes, m.chunk_id, m.sha256, CASE WHEN list_contains(chunks, m.chunk_id) THEN 'duplicate_chunk_id' WHEN list_contains(hashes, m.sha256) THEN 'duplicate_content'
    WHEN len(chunks) >= 8 THEN 'top_k' ELSE 'relevance' END AS reason FROM fold JOIN m ON m.query_id = fold.query_id AND m.global_rank = fold.global_rank + 1)),
decided AS (
  SELECT m.query_id, m.position, m.chunk_id, m.family, m.level, m.relevance, m.global_rank, fold.reason, m.tokens FROM m JOIN fold ON m.query_id = fold.query_id AND m.global_rank = fold.global_rank
  UNION ALL SELECT query_id, position, chunk_id, family, NULL, NULL, NULL, CASE WHEN shadowed THEN 'shadowed_configuration' ELSE 'missing_content' END, tokens FROM d WHERE shadowed OR NOT has_content)"""


@query(f"{_FOLD} SELECT query_id, position, chunk_id, family, level, round(relevance, 6) AS relevance, global_rank, CASE WHEN reason = 'relevance' THEN 'selected' ELSE 'omitted' END AS action, reason FROM decided")
def context_selection(spark, sf_dir):
    """Every candidate's decision; the SQL folds rank by rank, as the rule is told."""
    found = selection.select_by_relevance(_candidates(spark, sf_dir), 8)
    return found.select("query_id", "position", "chunk_id", "family", "level", F.round("relevance", 6).alias("relevance"), "global_rank", "action", "reason")


@query(f"""{_FOLD} SELECT query_id, count(*) AS candidates, count(*) FILTER (WHERE reason = 'relevance') AS selected, round(count(*) FILTER (WHERE reason = 'relevance') / count(*), 6) AS recall,
round(count(*) FILTER (WHERE reason LIKE 'duplicate%') / count(*), 6) AS duplicate_ratio, coalesce(sum(CASE WHEN reason = 'relevance' THEN tokens END), 0)::BIGINT AS used,
round(greatest(0, 300 - coalesce(sum(CASE WHEN reason = 'relevance' THEN tokens END), 0)) / 300.0, 6) AS token_waste FROM decided GROUP BY 1""")
def context_metrics(spark, sf_dir):
    found = selection.context_metrics(selection.select_by_relevance(_candidates(spark, sf_dir), 8), 300)
    return found.select("query_id", "candidates", "selected", "used", *[F.round(c, 6).alias(c) for c in ("recall", "duplicate_ratio", "token_waste")])


@query(f"""WITH {_CANDIDATES}, f AS (SELECT query_id, chunk_id, min((CASE family WHEN 'structured' THEN 1 ELSE 3 END, position, family)) AS p FROM d WHERE NOT shadowed GROUP BY ALL)
SELECT query_id, chunk_id, p[3] AS family, p[2] AS position, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p[1], p[2], chunk_id) - 1 AS rank FROM f) WHERE rank < 10""")
def candidate_merge(spark, sf_dir):
    # a candidate is a line item, and their number is in the file's footer
    return selection.merge_first(_candidates(spark, sf_dir), 10, P.read(spark, sf_dir, "lineitem").count())


@query("""WITH c AS (SELECT o_custkey AS query_id, l_partkey AS chunk_id, CASE l_returnflag WHEN 'A' THEN 'structured' WHEN 'R' THEN 'graph' ELSE 'chunks' END AS family, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS f,
  (l_orderkey * 100 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey % 10000 AS position, l_discount AS score, CASE WHEN l_returnflag = 'N' THEN l_tax END AS vs, CASE WHEN l_quantity > 10 THEN l_discount END AS ks, CASE WHEN l_returnflag <> 'N' THEN l_suppkey % 5 END AS o FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT query_id, chunk_id, min((f, position, family)) AS p, max(score) AS score, max(vs) AS vector_score, max(ks) AS keyword_score FROM c GROUP BY ALL),
o AS (SELECT query_id, chunk_id, string_agg('s' || o, ',' ORDER BY p) AS origins FROM (SELECT query_id, chunk_id, o, min((f, position)) AS p FROM c WHERE o IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT query_id, chunk_id, p[3] AS family, p[2] AS position, score, vector_score, keyword_score, coalesce(origins, '') AS origins FROM g LEFT JOIN o USING (query_id, chunk_id)""")
def family_merge(spark, sf_dir):
    """Items of customers' orders in three families by their flag, each part once a customer."""
    orders = P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("query_id"))
    flag = F.col("l_returnflag")
    rows = P.read(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select(
        "query_id", F.col("l_partkey").alias("chunk_id"), F.when(flag == "A", "structured").when(flag == "R", "graph").otherwise("chunks").alias("family"), _position().alias("position"),
        F.col("l_discount").alias("score"), F.when(flag == "N", F.col("l_tax")).alias("vector_score"), F.when(F.col("l_quantity") > 10, F.col("l_discount")).alias("keyword_score"),
        F.when(flag != "N", F.array(F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")))).alias("origins"),
    )
    found = selection.merge_chunks(rows)
    return found.withColumn("origins", F.array_join("origins", ","))


@query("""WITH s AS (SELECT conv_id AS query_id, turn AS source, text, greatest(1, (length(text) + 3) // 4)::BIGINT AS w FROM conversations),
a AS (SELECT *, count(*) OVER q AS n, sum(w - 1) OVER q AS cap FROM s WINDOW q AS (PARTITION BY query_id)),
b AS (SELECT *, CASE WHEN cap = 0 THEN 0 ELSE ((60 - n) * (w - 1))::DOUBLE / cap END AS raw FROM a WHERE n <= 60),
e AS (SELECT *, least(w - 1, floor(raw)::BIGINT) AS extra FROM b), l AS (SELECT *, 60 - n - sum(extra) OVER (PARTITION BY query_id) AS rest, extra + 1 < w AS room FROM e),
k AS (SELECT *, 1 + extra + (room AND row_number() OVER (PARTITION BY query_id, room ORDER BY raw - floor(raw) DESC, source) <= rest)::INT AS allocated FROM l)
SELECT query_id, source, allocated::BIGINT AS allocated, CASE WHEN length(text) <= allocated * 4 THEN text ELSE rtrim(substring(text, 1, greatest(allocated * 4 - 3, 0)::INT)) || '...' END AS content FROM k""")
def repair_budget(spark, sf_dir):
    """A conversation's turns as the sources of one answer, cut to 60 tokens together."""
    turns = P.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("source"), F.coalesce("text", F.lit("")).alias("content"))
    return selection.fit_to_budget(turns, 60)


@query("""WITH c AS (SELECT source AS query_id, lang || (doc_id % 100) AS chunk_id, doc_id AS rank, sha256(text) AS h, length(text) AS chars, greatest(1, (length(text) + 3) // 4)::BIGINT AS tokens FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank) > 1 AS a, row_number() OVER (PARTITION BY query_id, h ORDER BY rank) > 1 AS b FROM c)
SELECT query_id, count(*) FILTER (WHERE a) AS duplicate_chunks, count(*) FILTER (WHERE b AND NOT a) AS duplicate_contents, coalesce(sum(CASE WHEN a OR b THEN chars END), 0)::BIGINT AS avoided_chars, coalesce(sum(CASE WHEN a OR b THEN tokens END), 0)::BIGINT AS avoided_tokens FROM k GROUP BY 1""")
def redundancy_report(spark, sf_dir):
    """The documents of a source as the candidates of a query."""
    docs = P.read(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("query_id"), F.concat("lang", (F.col("doc_id") % 100).cast("string")).alias("chunk_id"), F.col("doc_id").alias("rank"), F.sha2("text", 256).alias("sha256"), F.col("text").alias("content"))
    return selection.redundancy(rows)


#: The searches' SQL is that of the single queries, at other limits.
_TOKENS = ["the", "license", "version"]
_KEYWORD = """k AS (SELECT doc_id AS chunk_id, path, CASE WHEN m > 0 THEN least(1.0, m / 3.0 + least(0.25, f / 20.0)) ELSE 0.0 END AS score FROM (
  SELECT doc_id, source || '/' || doc_id || '.txt' AS path, contains(lower(text), 'the')::INT + contains(lower(text), 'license')::INT + contains(lower(text), 'version')::INT AS m,
    (length(text) - length(replace(lower(text), 'the', ''))) / 3 AS f FROM documents))"""
_VECTOR = """q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id AS chunk_id, greatest(0.0, least(1.0, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))))) AS score FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q)"""


@query(f"""WITH {_KEYWORD}, {_VECTOR},
kk AS (SELECT * FROM k WHERE score > 0 ORDER BY score DESC, path, chunk_id LIMIT 30), vv AS (SELECT * FROM (SELECT * FROM v ORDER BY score DESC, chunk_id LIMIT 30) WHERE score >= 0.2),
p AS (SELECT chunk_id, vv.score AS vs, kk.score AS ks FROM vv FULL JOIN kk USING (chunk_id)), s AS (SELECT min(vs) AS vl, max(vs) AS vh, min(ks) AS kl, max(ks) AS kh FROM p),
h AS (SELECT chunk_id, vs, ks, 0.6 * CASE WHEN vs IS NULL THEN 0 WHEN vh = vl THEN 1 ELSE (vs - vl) / (vh - vl) END + 0.4 * CASE WHEN ks IS NULL THEN 0 WHEN kh = kl THEN 1 ELSE (ks - kl) / (kh - kl) END AS score FROM p, s)
SELECT 'keyword' AS mode, chunk_id, round(score, 6) AS combined_score, row_number() OVER (ORDER BY score DESC, path, chunk_id) - 1 AS rank, 'completed' AS status FROM kk WHERE score >= 0.2 QUALIFY rank < 10
UNION ALL SELECT 'semantic', chunk_id, round(score, 6), row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rank, 'completed' FROM vv QUALIFY rank < 30
UNION ALL SELECT 'hybrid', chunk_id, round(score, 6), row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rank, 'completed' FROM h WHERE score >= 0.2 QUALIFY rank < 10
UNION ALL SELECT 'no index', NULL, NULL, NULL, 'insufficient_evidence'""")
def search_service(spark, sf_dir):
    """One question in each mode, the semantic one with its top-k deferred, and one without an index."""
    chunks, vectors, asked = P.chunks(spark, sf_dir), P.vectors(spark, sf_dir), P.query_vector(spark, sf_dir)
    out = None
    for name, mode, index in (("keyword", "keyword", vectors), ("semantic", "semantic", vectors), ("hybrid", "hybrid", vectors), ("no index", "semantic", None)):
        found = retrieval.search(chunks, index, _TOKENS, asked, mode, 10, 30, 0.2, defer_top_k=mode == "semantic")
        found = found.select(F.lit(name).alias("mode"), "chunk_id", F.round("combined_score", 6).alias("combined_score"), "rank", "status")
        out = found if out is None else out.unionByName(found)
    return out


@query("""WITH s AS (SELECT p_partkey AS symbol_id, CASE WHEN p_size % 2 = 0 THEN 'oracle' ELSE 'powerbuilder' END AS technology, lower(p_brand) || '/' || p_size || '/' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '.SQL' ELSE '.srw' END AS path,
  CASE p_size % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'view' ELSE 'procedure' END AS kind, p_size % 5 <> 0 AS active, p_name FROM part)
SELECT 'inventory' AS filter, symbol_id FROM s WHERE technology = 'oracle' AND kind = 'procedure' AND active AND p_name ILIKE '%e%' AND path ILIKE 'BRAND#1%'
UNION ALL SELECT 'structured', symbol_id FROM s WHERE technology = 'oracle' AND starts_with(path, 'brand#1') AND path ILIKE '%.sql'""")
def symbol_filters(spark, sf_dir):
    """Parts as symbols, by the filters of the inventory and of structured search."""
    size = F.col("p_size")
    path = F.concat(F.lower("p_brand"), F.lit("/"), size, F.lit("/"), F.col("p_partkey"), F.when(size % 3 == 0, ".SQL").otherwise(".srw"))
    symbols = P.read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("symbol_id"), F.when(size % 2 == 0, "oracle").otherwise("powerbuilder").alias("technology"), F.lit(None).cast("string").alias("artifact_kind"), path.alias("relative_path"),
        F.when(size % 4 == 0, "table").when(size % 4 == 1, "view").otherwise("procedure").alias("symbol_type"), F.col("p_brand").alias("container"), F.lower("p_name").alias("name"), F.col("p_name").alias("original_name"),
        F.when(size % 5 != 0, "active").otherwise("deleted").alias("status"), F.lit("high").alias("confidence"), F.col("p_partkey").alias("document_id"),
    )
    a = catalog.inventory(symbols, technology=" Oracle", symbol_type="PROCEDURE", name="E", path="BRAND#1")
    b = retrieval.structured_filter(symbols, language="plsql", folder="brand#1", extension=".Sql")
    return a.select(F.lit("inventory").alias("filter"), "symbol_id").unionByName(b.select(F.lit("structured").alias("filter"), "symbol_id"))


@query(f"""WITH {P.RING_SQL}, e AS (SELECT *, ['low', 'medium', 'high'][source % 3 + 1] AS confidence, source % 9 <> 0 AS active FROM ring),
s AS (SELECT p_partkey AS id, p_size % 2 AS t, p_size % 4 AS d FROM part),
b AS (SELECT source AS node, target AS neighbour, relation_id, relation_type, resolution_status, coalesce(target, 0) AS k, 'outgoing' AS direction FROM e WHERE active AND confidence <> 'low'
  UNION ALL SELECT target, source, relation_id, relation_type, resolution_status, coalesce(target, 0), 'incoming' FROM e WHERE active AND confidence <> 'low' AND target IS NOT NULL)
SELECT node, neighbour, relation_id, b.direction, row_number() OVER (PARTITION BY node ORDER BY relation_type, resolution_status, 'part' || k, relation_id, b.direction) AS position FROM b JOIN s x ON x.id = node LEFT JOIN s y ON y.id = neighbour
WHERE relation_type IN ('calls', 'uses', 'references') AND (x.t = 0 OR coalesce(y.t = 0, false)) AND x.d = 2 AND coalesce(y.d, 2) = 2""")
def graph_adjacency(spark, sf_dir):
    """Relations at every part in both directions, by type, confidence, technology and domain."""
    third = F.element_at(F.array(*map(F.lit, graph.CONFIDENCES)), (F.col("source") % 3 + 1).cast("int"))
    edges = P.ring(spark, sf_dir).withColumns({"confidence": third, "status": F.when(F.col("source") % 9 != 0, "active").otherwise("deleted")})
    parts = P.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("symbol_id"), F.when(F.col("p_size") % 2 == 0, "oracle").otherwise("powerbuilder").alias("technology"), (F.col("p_size") % 4).cast("string").alias("domain"))
    found = graph.adjacent(edges, parts, parts.select(F.col("symbol_id").alias("node")), "both", ["calls", "uses", "references"], None, "medium", "Oracle", "2")
    return found.select("node", "neighbour", "relation_id", "direction", "position")


@query("""WITH d AS (SELECT doc_id, unhex(sha256(text)) AS seed FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, sha256(seed || unhex('00000000')) AS h FROM d),
b AS (SELECT doc_id, list_transform(range(8), lambda i: ('0x' || h[i * 2 + 1:i * 2 + 2])::INT / 255.0::DOUBLE) AS b FROM h)
SELECT doc_id, array_to_string(list_transform(b, lambda x: round(x / sqrt(list_sum(list_transform(b, lambda y: y * y))), 6)), ',') AS embedding FROM b""")
def digest_embeddings(spark, sf_dir):
    rows = P.read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", V.digest_embedding(F.col("text")).alias("e"))
    return rows.select("doc_id", F.array_join(F.transform("e", lambda x: F.round(x, 6).cast("string")), ",").alias("embedding"))


@query("""WITH c AS (SELECT l_suppkey % 5 AS policy, l_linenumber AS expected, l_discount AS recall, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS noise, l_linenumber AS selected, l_quantity AS tokens, l_extendedprice AS ms FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY policy) AS n FROM c)
SELECT policy, round(avg(CASE WHEN expected > 1 THEN recall END), 6) AS multi_recall, round(sum(noise) / greatest(1, sum(selected)), 6) AS noise_ratio, round(avg(selected), 3) AS chunks, round(avg(tokens), 3) AS tokens,
round(max(CASE WHEN i = n // 2 THEN ms END), 6) AS middle_ms FROM o GROUP BY 1""")
def graph_benchmark(spark, sf_dir):
    """Line items as cases of five policies."""
    rows = P.read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("policy"), F.col("l_linenumber").alias("expected"), F.col("l_discount").alias("recall"), (F.col("l_returnflag") == "A").cast("int").alias("noise"),
        F.col("l_linenumber").alias("selected"), F.col("l_quantity").alias("tokens"), F.col("l_extendedprice").alias("elapsed_ms"),
    )
    return evaluation.graph_benchmark(rows).drop("mean_ms")


@query("""WITH c AS (SELECT o_orderkey AS case_id, list_distinct(list(l_partkey)) AS chosen, list_distinct(list(l_partkey) FILTER (WHERE l_returnflag = 'A')) AS expected, list_distinct(list('F' || l_linenumber)) AS allowed,
  list_distinct(list('F' || l_linenumber) FILTER (WHERE l_returnflag = 'A')) AS wanted, list_distinct(list('F' || (l_linenumber + CASE WHEN l_discount > 0.05 THEN 0 ELSE 3 END)) FILTER (WHERE l_discount > 0.02)) AS said FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
n AS (SELECT case_id, coalesce(len(expected), 0) AS e, coalesce(len(said), 0) AS s, coalesce(len(list_intersect(said, allowed)), 0) AS v, coalesce(len(wanted), 0) AS w, coalesce(len(list_intersect(said, wanted)), 0) AS r FROM c)
SELECT case_id, CASE WHEN s = 0 THEN 0.0 ELSE round(v / s, 6) END AS citation_precision, CASE WHEN e = 0 THEN 1.0 WHEN w = 0 THEN 0.0 ELSE round(r / w, 6) END AS citation_recall FROM n""")
def citation_scores(spark, sf_dir):
    """Orders as cases: their items are the sources, the returned ones the expected, and the discounted ones are cited, some under a false number."""
    number = F.concat(F.lit("F"), F.col("l_linenumber").cast("string"))
    cited = F.concat(F.lit("[F"), (F.col("l_linenumber") + F.when(F.col("l_discount") > 0.05, 0).otherwise(3)).cast("string"), F.lit("]"))
    rows = P.read(spark, sf_dir, "lineitem").join(P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    # an item of an order is expected or not by its own flag, so expected ones get a key of their own
    chunk = F.concat(F.col("l_returnflag"), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey"))
    cases = rows.groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.collect_list(F.when(F.col("l_discount") > 0.02, cited)).alias("_a"), F.collect_list(F.when(F.col("l_returnflag") == "A", chunk)).alias("expected"), F.collect_list(F.struct(number.alias("source_id"), chunk.alias("chunk_id"))).alias("selected")
    )
    cases = cases.select("case_id", F.lit("").alias("context"), F.array_join("_a", " ").alias("answer"), F.array().cast("array<string>").alias("facts"), "expected", "selected")
    return evaluation.context_scores(cases).select("case_id", "citation_precision", "citation_recall")


@query("SELECT o_orderkey AS case_id, r_name AS model, ((r_regionkey - o_orderkey % 5) % 5 + 5) % 5 AS place FROM orders, region")
def execution_order(spark, sf_dir):
    """Regions as models, orders as cases."""
    models = P.read(spark, sf_dir, "region").select(F.col("r_name").alias("model"), F.col("r_regionkey").alias("index"))
    return evaluation.execution_order(models, P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") % 5).alias("case_index")))


@query("""SELECT c_custkey AS answer_id, CASE c_custkey % 8 WHEN 0 THEN 'valid' WHEN 1 THEN 'unknown_citation' WHEN 2 THEN 'no_valid_citation' WHEN 3 THEN 'not_answering' WHEN 4 THEN 'contradiction' WHEN 5 THEN 'unsupported' WHEN 6 THEN 'unsupported' ELSE 'valid' END AS verdict,
CASE WHEN c_custkey % 8 IN (5, 6) THEN 1 ELSE 0 END AS n_unsupported, CASE WHEN c_custkey % 8 = 4 THEN 1 ELSE 0 END AS n_contradictions FROM customer""")
def answer_verdicts(spark, sf_dir):
    """An answer a customer on two sources, of eight kinds by its number; the SQL has the verdict from the kind."""
    k = F.col("c_custkey")
    rows = P.read(spark, sf_dir, "customer").select(k, (k % 8).alias("kind"), k.cast("string").alias("n"))
    true = F.concat(F.lit("La tabla cliente_"), "n", F.lit(" usa índice_"), "n", F.lit(" siempre"))
    aside = F.when(k % 16 == 0, F.concat(F.lit("\n```sql\ncarga_"), "n", F.lit(" sin cita\n```\n## Titulo nocturno\n- Proceso carga_"), "n", F.lit(" nocturno [F2]"))).otherwise("")
    text = (
        F.when(F.col("kind") == 1, F.concat(true, F.lit(" [F9].")))
        .when(F.col("kind") == 2, F.concat(true, F.lit(".")))
        .when(F.col("kind") == 4, F.concat(F.lit("La tabla cliente_"), "n", F.lit(" no usa indice_"), "n", F.lit(" [F1].")))
        .when(F.col("kind") == 5, F.concat(F.lit("La tabla otra_"), "n", F.lit(" guarda saldo [F1].")))
        .when(F.col("kind") == 6, F.concat(true, F.lit(" [F1].\n\nEl proceso carga_"), "n", F.lit(" también corre.")))
        .when(F.col("kind") == 7, F.lit("Evidencia insuficiente [F1]."))
        .otherwise(F.concat(true, F.lit(" [F1]."), aside))
    )
    question = F.when(F.col("kind").isin(3, 7), "precio moneda cambio").otherwise(F.concat(F.lit("tabla cliente_"), "n", F.lit(" campo saldo")))
    answers = rows.select(k.alias("answer_id"), question.alias("question"), text.alias("text"))
    first = F.concat(F.lit("La tabla CLIENTE_"), "n", F.lit(" usa indice_"), "n", F.lit(" para el campo saldo"))
    second = F.concat(F.lit("El proceso carga_"), "n", F.lit(" es nocturno"))
    sources = rows.select(k.alias("answer_id"), F.explode(F.array(F.struct(F.lit("F1").alias("source_id"), first.alias("content")), F.struct(F.lit("F2").alias("source_id"), second.alias("content")))).alias("_s")).select("answer_id", "_s.*")
    return context.validate_answers(answers, sources, ["para", "siempre"])


@query("""WITH c AS (SELECT doc_id AS chunk_id, sha256(text) AS h, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) = '' AS blank FROM documents),
s AS (SELECT p.doc_id AS chunk_id, sha256(p.text) AS h, p.lang = 'de' AS failed FROM documents p WHERE p.source <> 'src3'
  UNION ALL SELECT -1 - conv_id, sha256('' || conv_id), false FROM (SELECT DISTINCT conv_id FROM conversations)),
j AS (SELECT chunk_id, c.chunk_id IS NOT NULL AS here, s.chunk_id IS NOT NULL AS known, s.failed, blank FROM (SELECT *, chunk_id AS i FROM c) c FULL JOIN s USING (chunk_id)),
a AS (SELECT *, CASE WHEN NOT here THEN 'delete' WHEN NOT known THEN 'new' WHEN failed THEN 'update' ELSE 'unchanged' END AS action FROM j)
SELECT action, CASE WHEN action = 'delete' THEN 'deleted' WHEN action <> 'unchanged' AND blank THEN 'error' ELSE 'indexed' END AS status, count(*) AS n FROM a GROUP BY ALL""")
def index_run(spark, sf_dir):
    """Documents indexed anew after an index of all sources but one, of which one language failed, and which also held the conversations."""
    docs = P.read(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("sha256"), F.col("text").alias("content"))
    vector = F.array(F.lit(1.0))
    held = docs.filter("source != 'src3'").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("sha256"), F.when(F.col("lang") == "de", "error").otherwise("indexed").alias("status"), vector.alias("embedding"))
    talks = P.read(spark, sf_dir, "conversations").select("conv_id").distinct().select((-1 - F.col("conv_id")).alias("chunk_id"), F.sha2(F.col("conv_id").cast("string"), 256).alias("sha256"), F.lit("indexed").alias("status"), vector.alias("embedding"))
    done = runs.index(chunks, held.unionByName(talks), 8)
    return done.groupBy("action", "status").agg(F.count(F.lit(1)).alias("n"))

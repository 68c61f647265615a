"""The engine's operators as registered queries over the given tables, with the same results as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions import vectors as V
from tracewell.operators import catalog, context, evaluation, graph, incremental, inventory, resolution, retrieval
from tracewell.plans import tables as P
from tracewell.plans.materialize import written
from tracewell.plans.registry import QUERIES, SQL, Query, query
from tracewell.sources import code

QUESTION = "the license version of that and 3"
TOKENS = ["the", "license", "version", "of", "that", "and", "3"]
CONCEPTS = ["license", "version", "public", "that", "with"]
STOPWORDS = ["that", "with", "from", "were", "this", "have"]


def _keyword_sql(tokens: list[str], text: str = "content") -> str:
    matched = " + ".join(f"contains(lower({text}), '{t}')::INT" for t in tokens)
    first = f"(length({text}) - length(replace(lower({text}), '{tokens[0]}', ''))) / {len(tokens[0])}"
    return f"CASE WHEN ({matched}) > 0 THEN least(1.0, ({matched}) / {float(len(tokens))} + least(0.25, {first} / 20.0)) ELSE 0.0 END"


_TOP = f"SELECT chunk_id, relative_path, score FROM (SELECT *, {_keyword_sql(TOKENS)} AS score FROM chunks)"


@query(f"WITH {P.CHUNKS_SQL} SELECT chunk_id, relative_path, round(score, 6) AS score FROM ({_TOP} WHERE score > 0 ORDER BY score DESC, relative_path, chunk_id LIMIT 20)")
def keyword_topk(spark, sf_dir):
    found = retrieval.keyword_search(P.chunks(spark, sf_dir), TOKENS, 20)
    return found.select("chunk_id", "relative_path", F.round("score", 6).alias("score"))


@query(
    f"WITH {P.CHUNKS_SQL} SELECT chunk_id, relative_path, round(score, 6) AS score FROM (SELECT * FROM (SELECT *, {_keyword_sql(TOKENS)} AS score FROM chunks "
    "WHERE domain = 'en' AND relative_path ILIKE 'SRC1%') WHERE score > 0 ORDER BY score DESC, relative_path, chunk_id LIMIT 20)"
)
def keyword_topk_filtered(spark, sf_dir):
    chunks = retrieval.keyword_filter(P.chunks(spark, sf_dir), domain="en", folder="SRC1", language="klingon")
    return retrieval.keyword_search(chunks, TOKENS, 20).select("chunk_id", "relative_path", F.round("score", 6).alias("score"))


_COSINE = """vectors AS (
  SELECT a.vec_id AS chunk_id, a.label, list_transform(a.embedding, lambda x: x::DOUBLE) AS v, (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 0) AS q FROM embeddings a),
scored AS (SELECT chunk_id, label, greatest(0.0, least(1.0, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))))) AS score FROM vectors)"""


@query(f"WITH {_COSINE} SELECT chunk_id, round(score, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 20)")
def vector_topk(spark, sf_dir):
    found = retrieval.vector_search(P.vectors(spark, sf_dir), P.query_vector(spark, sf_dir), 20)
    return found.select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_COSINE} SELECT chunk_id, round(score, 6) AS score FROM (SELECT * FROM scored WHERE label = 3 ORDER BY score DESC, chunk_id LIMIT 20)")
def vector_topk_filtered(spark, sf_dir):
    found = retrieval.vector_search(retrieval.vector_filter(P.vectors(spark, sf_dir), label=3), P.query_vector(spark, sf_dir), 20)
    return found.select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_COSINE} SELECT chunk_id, round(score, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 50) WHERE score >= 0.25")
def vector_threshold(spark, sf_dir):
    found = retrieval.vector_search(P.vectors(spark, sf_dir), P.query_vector(spark, sf_dir), 50, 0.25)
    return found.select("chunk_id", F.round("score", 6).alias("score"))


@query(f"""WITH {P.CHUNKS_SQL}, {_COSINE},
k AS (SELECT chunk_id, score FROM ({_TOP}) WHERE score > 0 ORDER BY score DESC, relative_path, chunk_id LIMIT 50),
v AS (SELECT chunk_id, score FROM scored ORDER BY score DESC, chunk_id LIMIT 50),
both AS (SELECT chunk_id, v.score AS vs, k.score AS ks FROM v FULL JOIN k USING (chunk_id)),
span AS (SELECT min(vs) AS vl, max(vs) AS vh, min(ks) AS kl, max(ks) AS kh FROM both),
fused AS (SELECT chunk_id, vs, ks, 0.6 * coalesce((vs - vl) / (vh - vl), 0) + 0.4 * coalesce(CASE WHEN kh = kl AND ks IS NOT NULL THEN 1 ELSE (ks - kl) / nullif(kh - kl, 0) END, 0) AS score FROM both, span)
SELECT chunk_id, round(vs, 6) AS vector_score, round(ks, 6) AS keyword_score, round(score, 6) AS combined_score FROM (SELECT * FROM fused ORDER BY score DESC, chunk_id LIMIT 10)""".replace("both", "pairs"))
def hybrid_topk(spark, sf_dir):
    keyword = retrieval.keyword_search(P.chunks(spark, sf_dir), TOKENS, 50).select("chunk_id", "score")
    vector = retrieval.vector_search(P.vectors(spark, sf_dir), P.query_vector(spark, sf_dir), 50).select("chunk_id", "score")
    fused = retrieval.hybrid_fusion(vector, keyword, 0.6, 0.4, 10)
    return fused.select("chunk_id", *[F.round(c, 6).alias(c) for c in ("vector_score", "keyword_score", "combined_score")])


@query("SELECT source, sum(greatest(1, (length(text) + 3) // 4))::BIGINT AS tokens, max(greatest(1, (length(text) + 3) // 4))::BIGINT AS longest FROM documents GROUP BY source")
def token_estimate(spark, sf_dir):
    tokens = T.estimate_tokens(F.col("text"))
    return P.read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(tokens).alias("tokens"), F.max(tokens).alias("longest"))


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length(t) > 240 THEN rtrim(substring(t, 1, 237)) || '...' ELSE t END AS snippet FROM (SELECT doc_id, {_FLAT} AS t FROM documents)")
def snippet(spark, sf_dir):
    return P.read(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size_bytes FROM documents")
def sha_identity(spark, sf_dir):
    return P.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("SELECT page_id, sha256(regexp_replace(regexp_replace(html, '^' || chr(65279), ''), chr(13) || chr(10) || '?', chr(10), 'g')) AS sha256, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS extension FROM pages")
def normalize_text(spark, sf_dir):
    return P.read(spark, sf_dir, "pages").select(
        "page_id", F.sha2(T.normalize_newlines(F.col("html")), 256).alias("sha256"), T.folder_of(F.col("url")).alias("folder"), T.extension_of(F.col("url")).alias("extension")
    )


_CONCEPTS_SQL = (
    "list_filter(list_distinct(regexp_extract_all(translate(lower(text), 'áéíóúñ', 'aeioun'), '[a-z_][a-z0-9_]*')), lambda t: (length(t) >= 4 OR contains(t, '_')) AND NOT regexp_full_match(t, 'f[0-9]+') "
    f"AND NOT list_contains({STOPWORDS}, t))"
)


@query(f"SELECT doc_id, len(c)::BIGINT AS n_concepts, sha256(array_to_string(list_sort(c), ' ')) AS concepts_sha256 FROM (SELECT doc_id, {_CONCEPTS_SQL} AS c FROM documents)")
def concept_tokens(spark, sf_dir):
    found = P.read(spark, sf_dir, "documents").select("doc_id", T.important_tokens(F.col("text"), STOPWORDS).alias("c"))
    return found.select("doc_id", F.size("c").cast("long").alias("n_concepts"), F.sha2(F.array_join(F.array_sort("c"), " "), 256).alias("concepts_sha256"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, min_by(source, doc_id) AS source FROM documents GROUP BY 1")
def exact_dedupe(spark, sf_dir):
    docs = P.read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    return retrieval.first_occurrences(docs, ["sha256"], ["doc_id"]).select("sha256", "doc_id", "source")


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_chunk FROM documents GROUP BY 1")
def duplicate_kinds(spark, sf_dir):
    return context.duplicate_kinds(P.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("sha256")))


_RANKED = f"""rows AS (SELECT doc_id, lang AS family, contains(lower(text), 'license') AS exact, {_keyword_sql(TOKENS, 'text')} AS score FROM documents),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY family ORDER BY exact DESC, score DESC) - 1 AS level FROM rows)"""


@query(f"WITH {_RANKED} SELECT doc_id, family, level, round(CASE WHEN max(level) OVER (PARTITION BY family) = 0 THEN 1.0 ELSE 1 - level / (max(level) OVER (PARTITION BY family)) END, 6) AS relevance FROM ranked")
def relevance_dense_rank(spark, sf_dir):
    docs = P.read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.col("lang").alias("family"), F.contains(F.lower("text"), F.lit("license")).alias("exact"), T.keyword_score(F.col("text"), TOKENS).alias("score"))
    return retrieval.relative_relevance(rows).select("doc_id", "family", "level", F.round("relevance", 6).alias("relevance"))


@query(f"""WITH {P.GRAPH_SQL},
o AS (SELECT source AS symbol_id, count(DISTINCT relation_id) AS outgoing FROM graph GROUP BY 1), i AS (SELECT target AS symbol_id, count(DISTINCT relation_id) AS incoming FROM graph GROUP BY 1),
f AS (SELECT source AS symbol_id, count(DISTINCT file_id) AS referenced FROM graph WHERE relation_type = 'references' GROUP BY 1)
SELECT symbol_id, symbol_type, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming, coalesce(referenced, 0) AS referenced
FROM symbols LEFT JOIN o USING (symbol_id) LEFT JOIN i USING (symbol_id) LEFT JOIN f USING (symbol_id)""")
def inventory_items(spark, sf_dir):
    g = P.graph(spark, sf_dir)
    relations = g.select(F.col("source").alias("source_symbol_id"), F.col("target").alias("target_symbol_id"), "relation_id")
    references = g.filter("relation_type = 'references'").select(F.col("source").alias("source_symbol_id"), F.col("file_id").alias("reference_id"))
    return inventory.inventory_items(P.symbols(spark, sf_dir), relations, references)


@query(f"""WITH {P.GRAPH_SQL} SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(DISTINCT source) FROM graph) AS sources,
(SELECT count(DISTINCT target) FROM graph) AS targets, (SELECT count(DISTINCT relation_id) FROM graph) AS relations""")
def inventory_summary(spark, sf_dir):
    relations = P.graph(spark, sf_dir).select(F.col("source").alias("source_symbol_id"), F.col("target").alias("target_symbol_id"), "relation_id")
    return inventory.inventory_summary(P.symbols(spark, sf_dir), relations)


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def stats_by_kind(spark, sf_dir):
    return inventory.status_counts(P.read(spark, sf_dir, "orders"), "o_orderpriority", ["F", "O", "P"], "o_orderstatus")


@query("SELECT count(*) AS runs, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, round(avg(value), 6) AS mean_value, max(event_id) AS last_run, max_by(event_type, event_id) AS last_status FROM events")
def rag_stats(spark, sf_dir):
    runs = P.read(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("status"), "value")
    return inventory.run_statistics(runs, ["click", "view"]).withColumn("mean_value", F.round("mean_value", 6))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def dominant_code(spark, sf_dir):
    return inventory.dominant_value(P.read(spark, sf_dir, "events"), "event_type")


@query("""SELECT s_suppkey AS manifest_id, s_name, coalesce(total, 0) AS total, coalesce(A, 0) AS A, coalesce(N, 0) AS N, coalesce(R, 0) AS R FROM supplier LEFT JOIN
(SELECT l_suppkey, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'A') AS A, count(*) FILTER (WHERE l_returnflag = 'N') AS N, count(*) FILTER (WHERE l_returnflag = 'R') AS R FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey""")
def embedding_summaries(spark, sf_dir):
    manifests = P.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("manifest_id"), "s_name")
    rows = P.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("manifest_id"), F.col("l_returnflag").alias("status"))
    return inventory.manifest_summaries(manifests, rows, ["A", "N", "R"])


@query("SELECT vec_id, label FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id)")
def orphan_anti(spark, sf_dir):
    return inventory.without_partner(P.read(spark, sf_dir, "embeddings").select("vec_id", "label"), P.read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "vec_id"), ["vec_id"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def deleted_semi(spark, sf_dir):
    gone = P.read(spark, sf_dir, "customer").filter("c_acctbal < 0").withColumnRenamed("c_custkey", "o_custkey")
    return inventory.with_partner(P.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_orderkey DESC LIMIT 1")
def exists_or_latest(spark, sf_dir):
    runs = P.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderstatus") == "P").alias("pending"))
    errors = P.read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    return inventory.latest_with(runs, errors, "o_orderkey", "pending").drop("pending")


@query("SELECT l_orderkey AS file_id, l_linenumber, l_suppkey AS last_run_id FROM lineitem WHERE l_suppkey <> 1 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def stale_sweep(spark, sf_dir):
    rows = P.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), "l_linenumber", F.col("l_suppkey").alias("last_run_id"))
    files = P.read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").withColumnRenamed("o_orderkey", "file_id")
    return incremental.stale_rows(rows, files, 1)


@query("""SELECT path, CASE WHEN d % 5 = 0 THEN 'new' WHEN d % 7 = 0 THEN 'previous_error' WHEN d % 11 = 0 THEN 'not_processed' WHEN d % 13 = 0 THEN 'signature_changed' WHEN d % 3 <> 0 THEN 'unchanged'
WHEN d % 2 = 0 THEN 'touch' ELSE 'content_changed' END AS decision, NOT (d % 5 <> 0 AND d % 7 <> 0 AND d % 11 <> 0 AND d % 13 <> 0 AND (d % 3 <> 0 OR d % 2 = 0)) AS process
FROM (SELECT source || '/' || doc_id AS path, doc_id AS d FROM documents)""")
def incremental_decision(spark, sf_dir):
    """The documents as found files against an earlier state of them in which every kind of change is."""
    docs = P.read(spark, sf_dir, "documents")
    d = F.col("doc_id")
    now = docs.select(F.concat_ws("/", "source", d.cast("string")).alias("path"), F.octet_length("text").alias("size_bytes"), d.alias("modified_ns"), F.sha2("text", 256).alias("sha256"), d)
    known = now.filter(d % 5 != 0).select(
        "path",
        "size_bytes",
        F.when(d % 3 == 0, d + 1).otherwise(d).alias("modified_ns"),
        F.when(d % 2 == 0, F.col("sha256")).otherwise(F.sha2(F.concat("sha256", F.lit("old")), 256)).alias("sha256"),
        F.when(d % 13 == 0, "old").otherwise("now").alias("signature"),
        F.when(d % 7 == 0, "error").when(d % 11 == 0, "skipped").otherwise("processed").alias("status"),
    )
    return incremental.file_decisions(now.drop("doc_id"), known, "now").select("path", "decision", "process")


@query("""WITH now AS (SELECT doc_id AS chunk_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 4 <> 0),
old AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE sha256(text) END AS sha256, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'indexed' END AS status FROM documents WHERE doc_id % 7 <> 0)
SELECT chunk_id, CASE WHEN now.sha256 IS NULL THEN 'delete' WHEN status IS NULL THEN 'new' WHEN status <> 'indexed' OR old.sha256 <> now.sha256 THEN 'update' ELSE 'unchanged' END AS action FROM now FULL JOIN old USING (chunk_id)""")
def index_plan(spark, sf_dir):
    """The documents' chunks after some were removed, against index states of which some are missing, failed or outdated."""
    base = P.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("sha256"))
    d = F.col("chunk_id")
    old = base.filter(d % 7 != 0).select("chunk_id", F.when(d % 3 == 0, "x").otherwise(F.col("sha256")).alias("sha256"), F.when(d % 5 == 0, "failed").otherwise("indexed").alias("status"))
    return incremental.index_plan(base.filter(d % 4 != 0), old)


_RANGES = "ranges AS (SELECT l_orderkey AS document_id, l_linenumber AS range_id, l_linenumber * 10 AS start_line, l_linenumber * 10 + (l_quantity % 17)::INT AS end_line FROM lineitem)"


@query(f"WITH {_RANGES} SELECT a.document_id, a.range_id AS first, b.range_id AS second FROM ranges a JOIN ranges b USING (document_id) WHERE a.range_id <> b.range_id AND a.start_line <= b.start_line AND b.start_line <= a.end_line + 1 AND a.end_line <= b.end_line")
def contiguous_ranges(spark, sf_dir):
    lines = P.read(spark, sf_dir, "lineitem")
    start = F.col("l_linenumber") * 10
    return context.contiguous_ranges(
        lines.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("range_id"), start.alias("start_line"), (start + (F.col("l_quantity") % 17).cast("int")).alias("end_line"))
    )


@query(f"""WITH {_RANGES}, chunks AS (SELECT document_id, range_id AS chunk_id, range_id AS ordinal, start_line, end_line FROM ranges),
records AS (SELECT o_orderkey AS record_id, o_orderkey AS document_id, o_orderkey % 71 AS line FROM orders)
SELECT record_id, coalesce(min(chunk_id) FILTER (WHERE line BETWEEN start_line AND end_line), min(chunk_id)) AS chunk_id, count(*) FILTER (WHERE line BETWEEN start_line AND end_line) > 0 AS covered
FROM records LEFT JOIN chunks USING (document_id) GROUP BY record_id""")
def evidence_range_join(spark, sf_dir):
    start = F.col("l_linenumber") * 10
    chunks = P.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_id"), F.col("l_linenumber").alias("ordinal"), start.alias("start_line"), (start + (F.col("l_quantity") % 17).cast("int")).alias("end_line")
    )
    records = P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderkey").alias("document_id"), (F.col("o_orderkey") % 71).alias("line"))
    return context.covering_chunk(records, chunks)


def _resolution(spark, sf_dir):
    """Parts are symbols named by groups of four keys, in containers by brand; line items are references to them."""
    part, line = P.read(spark, sf_dir, "part"), P.read(spark, sf_dir, "lineitem")
    symbols = part.select(F.col("p_partkey").alias("symbol_id"), F.concat(F.lit("n"), F.floor(F.col("p_partkey") / 4)).alias("name"), F.lower("p_brand").alias("container"), F.lit("table").alias("symbol_type"), F.when(F.col("p_size") % 2 == 0, "oracle").otherwise("powerbuilder").alias("technology"))
    name = F.concat(F.lit("n"), F.floor(F.col("l_partkey") / 4))
    references = line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), "l_returnflag").alias("reference_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("brand#11."), name)).otherwise(name).alias("target"),
        F.lit("table").alias("reference_type"),
        F.when(F.col("l_returnflag") == "N", "oracle").when(F.col("l_returnflag") == "A", "unknown").otherwise("powerbuilder").alias("technology"),
        F.concat(F.lit("brand#"), F.col("l_suppkey") % 5 + 1, F.lit("1")).alias("container"),
        (F.col("l_quantity") == 50).alias("dynamic"),
        (F.col("l_quantity") == 49).alias("external"),
    ).distinct()
    return references, symbols


_RESOLUTION = """s AS (SELECT p_partkey AS symbol_id, 'n' || (p_partkey // 4) AS name, lower(p_brand) AS container, CASE WHEN p_size % 2 = 0 THEN 'oracle' ELSE 'powerbuilder' END AS technology FROM part),
r AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT || '-' || l_returnflag AS reference_id, 'n' || (l_partkey // 4) AS leaf, l_linenumber % 2 = 0 AS qualified,
  CASE WHEN l_returnflag = 'N' THEN 'oracle' WHEN l_returnflag = 'A' THEN 'unknown' ELSE 'powerbuilder' END AS technology, 'brand#' || (l_suppkey % 5 + 1) || '1' AS container, l_quantity = 50 AS dynamic, l_quantity = 49 AS external FROM lineitem),
c AS (SELECT reference_id, symbol_id, s.container, name, r.container = s.container AS own, qualified FROM r JOIN s ON leaf = name AND (r.technology = s.technology OR r.technology = 'unknown') AND (NOT qualified OR s.container = 'brand#11')),
found AS (SELECT * FROM c QUALIFY qualified OR own OR NOT bool_or(own) OVER (PARTITION BY reference_id)),
n AS (SELECT reference_id, count(*) AS n_candidates, min(symbol_id) AS one FROM found GROUP BY 1),
relations AS (SELECT * FROM (SELECT reference_id, CASE WHEN dynamic THEN 'dynamic' WHEN external THEN 'external' WHEN n_candidates = 1 THEN 'resolved' WHEN n_candidates > 1 THEN 'ambiguous' END AS status, n_candidates, one FROM r LEFT JOIN n USING (reference_id)) WHERE status IS NOT NULL)"""


@query(f"WITH {_RESOLUTION} SELECT reference_id, status, CASE WHEN status = 'resolved' THEN 'detected' ELSE 'to_confirm' END AS classification, CASE WHEN status = 'resolved' THEN one END AS target_symbol_id, coalesce(n_candidates, 0) AS n_candidates FROM relations")
def resolve_references(spark, sf_dir):
    return resolution.resolve_all(*_resolution(spark, sf_dir), resolution.compatible_types(spark))


@query(f"WITH {_RESOLUTION} SELECT reference_id, symbol_id, row_number() OVER (PARTITION BY reference_id ORDER BY container, name, symbol_id)::INT AS rank FROM found JOIN relations USING (reference_id) WHERE status = 'ambiguous'")
def ambiguous_candidates(spark, sf_dir):
    return resolution.ranked_candidates(*_resolution(spark, sf_dir), resolution.compatible_types(spark))


@query("""WITH a AS (SELECT p_size AS configuration, p_brand AS value, p_partkey AS symbol_id FROM part WHERE p_partkey % 5 = 0),
t AS (SELECT p_partkey AS token_id, p_size AS configuration, p_brand AS value FROM part),
j AS (SELECT token_id, symbol_id, CASE WHEN a.configuration = t.configuration THEN 0 ELSE 1 END AS priority FROM t JOIN a USING (value))
SELECT token_id, count(*) AS n, min(symbol_id) AS first, any_value(priority) AS priority FROM (SELECT * FROM j QUALIFY priority = min(priority) OVER (PARTITION BY token_id)) GROUP BY 1""")
def alias_priority(spark, sf_dir):
    part = P.read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("configuration"), F.col("p_brand").alias("value"), F.lit("part").alias("symbol_type"))
    return resolution.alias_counts(part.withColumnRenamed("p_partkey", "token_id"), part.filter("p_partkey % 5 = 0").withColumnRenamed("p_partkey", "symbol_id"))


_CODE = f"""{P.SCRIPTS_SQL},
refs AS (
  SELECT l_orderkey AS document_id, 4 * k - 1 AS line, k, 'table' AS reference_type, 'part' || l_partkey AS target, 'high' AS confidence FROM items
  UNION ALL SELECT l_orderkey, 4 * k, k, 'call', CASE WHEN k % 3 = 0 THEN 'pkg' || l_orderkey || '.run1' ELSE 'sup' || l_suppkey || '.ship' END, 'medium' FROM items),
units AS (
  SELECT l_orderkey AS document_id, 'package_body' AS unit_type, 'pkg' || l_orderkey AS name, 1 AS start_line, 4 * max(k) + 2 AS end_line, 0 AS level, NULL AS parent FROM items GROUP BY l_orderkey
  UNION ALL SELECT l_orderkey, 'procedure', 'run' || k, 4 * k - 2, 4 * k + 1, 1, 'pkg' || l_orderkey FROM items)"""


@query(f"WITH {_CODE} SELECT document_id, line::INT AS line, reference_type, target, confidence FROM refs")
def oracle_references(spark, sf_dir):
    return code.references(P.scripts(spark, sf_dir), "oracle").drop("status")


@query(f"WITH {_CODE} SELECT document_id, unit_type, name, start_line::INT AS start_line, end_line::INT AS end_line, level, parent FROM units")
def oracle_objects(spark, sf_dir):
    return code.oracle_objects(P.scripts(spark, sf_dir))


def _powerscripts(spark, sf_dir):
    """Customers as exported windows, with an event and a function."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(
        F.lit("global type w_"), key, F.lit(" from window\nend type\nevent open;\n  open(w_"), F.col("c_nationkey").cast("string"), F.lit(") // open(w_no)\nend event\npublic function long of_get (long a);\n  uo_"),
        key, F.lit(".of_do(a)\n  MessageBox('open(w_no)')\n  UPDATE t_"), F.col("c_nationkey").cast("string"), F.lit(" SET a = 1;\n  dw_1.dataobject = \"d_"), key, F.lit("\"\nend function"),
    )
    return P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), text.alias("text"), F.when(F.col("c_custkey") % 10 == 0, ".pbl").otherwise(".srw").alias("extension"))


@query("""SELECT c_custkey AS document_id, unnest([1, 4, 7, 9, 10]) AS line, unnest(['table', 'open', 'call', 'table', 'datawindow']) AS reference_type,
  unnest(['window', 'w_' || c_nationkey, 'uo_' || c_custkey || '.of_do', 't_' || c_nationkey, 'd_' || c_custkey]) AS target, unnest(['high', 'high', 'medium', 'high', 'high']) AS confidence FROM customer""")
def powerbuilder_references(spark, sf_dir):
    return code.references(_powerscripts(spark, sf_dir), "powerbuilder").drop("status")


@query("""SELECT c_custkey AS document_id, 'library' AS unit_type, NULL AS name, NULL::INT AS start_line, NULL::INT AS end_line, 0 AS level, NULL AS parent, 'UNSUPPORTED_BINARY_PBL' AS error FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT c_custkey, unnest(['window', 'event', 'function']), unnest(['w_' || c_custkey, 'open', 'of_get']), unnest([1, 3, 6]), unnest([11, 5, 11]), unnest([0, 1, 1]), unnest([NULL, 'w_' || c_custkey, 'w_' || c_custkey]), NULL FROM customer WHERE c_custkey % 10 > 0""")
def powerbuilder_objects(spark, sf_dir):
    return code.powerbuilder_objects(_powerscripts(spark, sf_dir))


def _symbols(spark, sf_dir, again: bool = False) -> tuple[DataFrame, DataFrame]:
    """The scripts' symbols, and these with parts that fewer than a fifth lack as tables and suppliers' packages. again: the scripts' ones are read more than once."""
    none = lambda kind: F.lit(None).cast(kind)
    extra = [
        P.read(spark, sf_dir, table).filter(keep).select(key.alias("document_id"), kind.alias("unit_type"), name.alias("name"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), parent.alias("parent"))
        for table, keep, key, kind, name, parent in (
            ("part", "p_partkey % 5 > 0", F.col("p_partkey"), F.when(F.col("p_partkey") % 7 == 0, "view").otherwise("table"), F.concat(F.lit("part"), F.col("p_partkey")), none("string")),
            ("part", "p_partkey % 11 = 0", F.col("p_partkey") + 1000000000, F.lit("view"), F.concat(F.lit("part"), F.col("p_partkey")), none("string")),
            ("supplier", "s_suppkey % 3 > 0", F.col("s_suppkey"), F.lit("procedure"), F.lit("ship"), F.concat(F.lit("sup"), F.col("s_suppkey"))),
        )
    ]
    units = code.oracle_objects(P.scripts(spark, sf_dir)).select("document_id", "unit_type", "name", "start_line", "end_line", "parent")
    own = catalog.symbols_of(units, "oracle")
    symbols = own = written(own, "own-symbols") if again else own
    for more in extra:
        symbols = symbols.unionByName(catalog.symbols_of(more, "oracle"))
    return own, symbols


def _catalog(spark, sf_dir):
    """The scripts' references with their source, and all symbols."""
    own, symbols = _symbols(spark, sf_dir, True)
    references = catalog.sourced(code.references(P.scripts(spark, sf_dir), "oracle"), own, "oracle")
    # both are read several times, and scripts should be read once
    return written(references, "references"), written(symbols, "symbols")


_CATALOG = f"""{_CODE},
syms AS (
  SELECT document_id, name, parent AS container, replace(unit_type, '_body', '') AS symbol_type, start_line FROM units
  UNION ALL SELECT p_partkey, 'part' || p_partkey, NULL, CASE WHEN p_partkey % 7 = 0 THEN 'view' ELSE 'table' END, 1 FROM part WHERE p_partkey % 5 > 0
  UNION ALL SELECT p_partkey + 1000000000, 'part' || p_partkey, NULL, 'view', 1 FROM part WHERE p_partkey % 11 = 0
  UNION ALL SELECT s_suppkey, 'ship', 'sup' || s_suppkey, 'procedure', 1 FROM supplier WHERE s_suppkey % 3 > 0),
hits AS (
  SELECT refs.*, s.name AS s_name, s.container AS s_container, s.start_line AS s_line, s.document_id AS s_document FROM refs LEFT JOIN syms s
    ON (reference_type = 'table' AND s.symbol_type IN ('table', 'view') AND s.name = target) OR (reference_type = 'call' AND s.symbol_type IN ('procedure', 'function') AND s.container || '.' || s.name = target)),
outcomes AS (
  SELECT document_id, k, line, reference_type, target, count(s_name) AS n, min(s_name) AS one, min(s_container) AS one_container FROM hits GROUP BY ALL)"""


@query(f"WITH {_CATALOG} SELECT symbol_type, 'oracle' AS technology, count(*) AS symbols, (count(DISTINCT name) FILTER (WHERE twice))::BIGINT AS duplicates, 0::BIGINT AS unknown FROM (SELECT *, count(*) OVER (PARTITION BY symbol_type, name) > 1 AS twice FROM syms) GROUP BY symbol_type")
def symbol_catalog(spark, sf_dir):
    return catalog.catalog_summary(_symbols(spark, sf_dir)[1])


@query(f"WITH {_CATALOG} SELECT CASE n WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, count(*) AS n FROM outcomes GROUP BY 1")
def analyze_summary(spark, sf_dir):
    references, symbols = _catalog(spark, sf_dir)
    return catalog.resolution_counts(references, catalog.analyze(references, symbols))


@query(f"""WITH {_CATALOG} SELECT document_id AS file_id, 'run' || k AS source, CASE WHEN n = 1 THEN one END AS target, target AS target_key, CASE reference_type WHEN 'call' THEN 'calls' ELSE 'uses' END AS relation_type,
  CASE WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution_status, CASE WHEN n = 1 THEN 'detected' ELSE 'to_confirm' END AS classification FROM outcomes WHERE n > 0""")
def analyze_relations(spark, sf_dir):
    """Relations from text to graph, by the names of their ends."""
    references, symbols = _catalog(spark, sf_dir)
    found = catalog.analyze(references, symbols)
    names = symbols.select("symbol_id", "name")
    out = found.join(names.select(F.col("symbol_id").alias("source"), F.col("name").alias("_source")), "source").join(names.select(F.col("symbol_id").alias("target"), F.col("name").alias("_target")), "target", "left")
    return out.select("file_id", F.col("_source").alias("source"), F.col("_target").alias("target"), "target_key", "relation_type", "resolution_status", "classification")


@query(f"""WITH {_CATALOG}, asked AS (SELECT p_partkey AS request_id, 'part' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'view' END AS kind FROM part UNION ALL SELECT s_suppkey + 2000000000, 'sup' || s_suppkey || '.ship', NULL FROM supplier)
SELECT request_id, CASE count(s.name) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, count(s.name) AS matches
FROM asked LEFT JOIN syms s ON (asked.name = s.name OR asked.name = s.container || '.' || s.name) AND (kind IS NULL OR kind = s.symbol_type) GROUP BY request_id""")
def symbol_lookup(spark, sf_dir):
    """Parts are asked for by name, every second one as a view, and suppliers' procedures by container and name."""
    parts = P.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.concat(F.lit("PART"), F.col("p_partkey")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, "view").alias("symbol_type"))
    suppliers = P.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 2000000000).alias("request_id"), F.concat(F.lit("sup"), F.col("s_suppkey"), F.lit(".ship")).alias("name"), F.lit(None).cast("string").alias("symbol_type"))
    return catalog.lookup(parts.unionByName(suppliers), _catalog(spark, sf_dir)[1]).drop("symbol_id")


_TRACES = f"""{P.RING_SQL}, roots AS (SELECT p_partkey::BIGINT AS root FROM part WHERE p_size = 7),
k1 AS (SELECT root, root AS node FROM roots),
f1 AS (SELECT root, root AS node, [root] AS path FROM roots),
j1 AS (
  SELECT f.root, f.node, r.target AS next, relation_id, relation_type, path, CASE WHEN r.target IS NULL THEN resolution_status WHEN list_contains(path, r.target) THEN 'cycle'
    WHEN k.node IS NULL AND row_number() OVER (PARTITION BY f.root, r.target ORDER BY relation_type, relation_id, f.node) = 1 THEN 'accepted' ELSE 'duplicate' END AS s
  FROM f1 f JOIN ring r ON r.source = f.node LEFT JOIN k1 k ON k.root = f.root AND k.node = r.target),
l1 AS (
  SELECT root, node, next, relation_id, relation_type, path, 1 AS depth, CASE WHEN s = 'accepted' AND sum((s = 'accepted')::INT) OVER (PARTITION BY root ORDER BY relation_type, relation_id, node ROWS UNBOUNDED PRECEDING)
    + (SELECT count(*) - 1 FROM k1 k WHERE k.root = j1.root) > 5 THEN 'limit' ELSE s END AS status FROM j1),
k2 AS (SELECT root, node FROM k1 UNION ALL SELECT root, next FROM l1 WHERE status = 'accepted'),
f2 AS (SELECT root, next AS node, list_append(path, next) AS path FROM l1 WHERE status = 'accepted'),
j2 AS (
  SELECT f.root, f.node, r.target AS next, relation_id, relation_type, path, CASE WHEN r.target IS NULL THEN resolution_status WHEN list_contains(path, r.target) THEN 'cycle'
    WHEN k.node IS NULL AND row_number() OVER (PARTITION BY f.root, r.target ORDER BY relation_type, relation_id, f.node) = 1 THEN 'accepted' ELSE 'duplicate' END AS s
  FROM f2 f JOIN ring r ON r.source = f.node LEFT JOIN k2 k ON k.root = f.root AND k.node = r.target),
l2 AS (
  SELECT root, node, next, relation_id, relation_type, path, 2 AS depth, CASE WHEN s = 'accepted' AND sum((s = 'accepted')::INT) OVER (PARTITION BY root ORDER BY relation_type, relation_id, node ROWS UNBOUNDED PRECEDING)
    + (SELECT count(*) - 1 FROM k2 k WHERE k.root = j2.root) > 5 THEN 'limit' ELSE s END AS status FROM j2),
k3 AS (SELECT root, node FROM k2 UNION ALL SELECT root, next FROM l2 WHERE status = 'accepted'),
f3 AS (SELECT root, next AS node, list_append(path, next) AS path FROM l2 WHERE status = 'accepted'),
j3 AS (
  SELECT f.root, f.node, r.target AS next, relation_id, relation_type, path, CASE WHEN r.target IS NULL THEN resolution_status WHEN list_contains(path, r.target) THEN 'cycle'
    WHEN k.node IS NULL AND row_number() OVER (PARTITION BY f.root, r.target ORDER BY relation_type, relation_id, f.node) = 1 THEN 'accepted' ELSE 'duplicate' END AS s
  FROM f3 f JOIN ring r ON r.source = f.node LEFT JOIN k3 k ON k.root = f.root AND k.node = r.target),
l3 AS (
  SELECT root, node, next, relation_id, relation_type, path, 3 AS depth, CASE WHEN s = 'accepted' AND sum((s = 'accepted')::INT) OVER (PARTITION BY root ORDER BY relation_type, relation_id, node ROWS UNBOUNDED PRECEDING)
    + (SELECT count(*) - 1 FROM k3 k WHERE k.root = j3.root) > 5 THEN 'limit' ELSE s END AS status FROM j3),
traces AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"""


def _traces(spark, sf_dir):
    """From every part of size 7, three steps along a graph with cycles, five nodes a root."""
    roots = P.read(spark, sf_dir, "part").filter("p_size = 7").select(F.col("p_partkey").cast("long").alias("root"))
    return graph.traced_walk(P.ring(spark, sf_dir), roots, "outgoing", 3, 5)


@query(f"WITH {_TRACES} SELECT root, depth, node AS source, next AS target, relation_id, status, status = 'cycle' AS is_cycle FROM traces")
def dependency_traces(spark, sf_dir):
    return _traces(spark, sf_dir).select("root", "depth", "source", "target", "relation_id", "status", "is_cycle")


@query(f"""WITH {_TRACES}, closed AS (SELECT root, path[list_position(path, next):] AS c FROM traces WHERE status = 'cycle'), turned AS (SELECT root, c, list_position(c, list_min(c)) AS p FROM closed)
SELECT DISTINCT root, array_to_string(list_concat(c[p:], c[:p - 1]), '>') AS cycle FROM turned""")
def dependency_cycles(spark, sf_dir):
    return graph.cycles_of(_traces(spark, sf_dir)).select("root", F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"))


@query(f"""WITH {_TRACES}, kinds AS (SELECT p_partkey AS id, p_size % 2 AS t FROM part),
n AS (SELECT root, count(*) FILTER (WHERE status = 'accepted') AS nodes, count(*) FILTER (WHERE status = 'accepted' AND b.t <> a.t) AS cross_technology, count(*) FILTER (WHERE status = 'unresolved') AS unresolved,
  count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE status = 'cycle') AS cycles FROM traces LEFT JOIN kinds a ON a.id = root LEFT JOIN kinds b ON b.id = next GROUP BY root)
SELECT *, CASE WHEN cycles > 0 OR cross_technology > 10 THEN 'high' WHEN unresolved + ambiguous + cross_technology > 0 THEN 'medium' ELSE 'low' END AS risk FROM n""")
def impact_report(spark, sf_dir):
    kinds = P.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("symbol_id"), F.when(F.col("p_size") % 2 == 0, "oracle").otherwise("powerbuilder").alias("technology"))
    return graph.impact_report(_traces(spark, sf_dir), kinds)


@query(f"""WITH {_TRACES}, taken AS (SELECT root, relation_id, next, depth FROM traces WHERE status = 'accepted'),
shown AS (SELECT root, depth, CASE WHEN relation_id[1] = 'c' THEN next * 10 ELSE next END AS chunk_id FROM taken JOIN part ON p_partkey = next OR (relation_id[1] = 'c' AND p_partkey = next) WHERE relation_id[1] = 'c' OR p_partkey IS NOT NULL)
SELECT root, chunk_id, min(depth) AS depth, round(power(0.95, min(depth)), 6) AS score FROM shown GROUP BY root, chunk_id""")
def graph_trace_chunks(spark, sf_dir):
    """Calls have an evidence chunk, other relations fall back to the chunk of the node."""
    traces = _traces(spark, sf_dir)
    part = P.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node"))
    evidence = P.ring(spark, sf_dir).filter("relation_type = 'calls'").join(part, F.col("target") == F.col("node"), "left_semi").select("relation_id", (F.col("target") * 10).alias("chunk_id"))
    out = graph.traced_chunks(traces, evidence, part.withColumn("chunk_id", F.col("node")))
    return out.select("root", "chunk_id", "depth", F.round("score", 6).alias("score"))


def _seeds(spark, sf_dir):
    return P.read(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"))


_WALK = """steps AS ({steps}),
w0 AS (SELECT DISTINCT 'c' || c_custkey AS node, 0 AS depth FROM customer WHERE c_nationkey = 3),
w1 AS (SELECT DISTINCT neighbour AS node, 1 AS depth FROM steps JOIN w0 USING (node) WHERE neighbour NOT IN (SELECT node FROM w0)),
w2 AS (SELECT DISTINCT neighbour AS node, 2 AS depth FROM steps JOIN w1 USING (node) WHERE neighbour NOT IN (SELECT node FROM w0 UNION ALL SELECT node FROM w1)),
w3 AS (SELECT DISTINCT neighbour AS node, 3 AS depth FROM steps JOIN w2 USING (node) WHERE neighbour NOT IN (SELECT node FROM w0 UNION ALL SELECT node FROM w1 UNION ALL SELECT node FROM w2)),
nodes AS (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3)"""
_OUT = "SELECT source AS node, target AS neighbour, relation_id, relation_type FROM graph"
_BACK = "SELECT target AS node, source AS neighbour, relation_id, relation_type FROM graph"


@query(f"WITH {P.GRAPH_SQL}, {_WALK.format(steps=_OUT)} SELECT neighbour, relation_type, depth + 1 AS depth, count(*) AS edges, count(DISTINCT node) AS nodes FROM nodes JOIN steps USING (node) WHERE depth < 3 GROUP BY ALL")
def dependency_walk(spark, sf_dir):
    _, edges = graph.walk(P.graph(spark, sf_dir), _seeds(spark, sf_dir), "outgoing", 3)
    return edges.groupBy("neighbour", "relation_type", "depth").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("node").alias("nodes"))


@query(f"WITH {P.GRAPH_SQL}, {_WALK.format(steps=_OUT + ' UNION ALL ' + _BACK)} SELECT node, depth FROM nodes WHERE depth <= 2")
def reachability(spark, sf_dir):
    nodes, _ = graph.walk(P.graph(spark, sf_dir), _seeds(spark, sf_dir), "both", 2)
    return nodes


@query(f"""WITH {P.GRAPH_SQL}, {_WALK.format(steps=_OUT)}, back AS ({_BACK}),
b1 AS (SELECT DISTINCT neighbour AS node, 1 AS depth FROM back JOIN w0 USING (node) WHERE neighbour NOT IN (SELECT node FROM w0)),
b2 AS (SELECT DISTINCT neighbour AS node, 2 AS depth FROM back JOIN b1 USING (node) WHERE neighbour NOT IN (SELECT node FROM w0 UNION ALL SELECT node FROM b1))
SELECT 'dependency' AS role, node, depth, depth > 1 AS indirect FROM nodes WHERE depth BETWEEN 1 AND 2 UNION ALL SELECT 'consumer', node, depth, depth > 1 FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2)""")
def impact_split(spark, sf_dir):
    return graph.impact(P.graph(spark, sf_dir), _seeds(spark, sf_dir), 2)


@query(f"""WITH {P.GRAPH_SQL}, steps AS (SELECT source AS node, target AS neighbour FROM graph UNION SELECT target, source FROM graph),
s0 AS (SELECT 'c' || c_custkey AS node, (c_custkey % 10 + 1) / 10.0 AS score FROM customer WHERE c_nationkey = 3),
s1 AS (SELECT neighbour AS node, max(score) * 0.95 AS score FROM s0 JOIN steps USING (node) GROUP BY 1), s2 AS (SELECT neighbour AS node, max(score) * 0.95 AS score FROM s1 JOIN steps USING (node) GROUP BY 1)
SELECT node, round(max(score), 6) AS score FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY 1""")
def graph_decay_score(spark, sf_dir):
    seeds = P.read(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), ((F.col("c_custkey") % 10 + 1) / 10.0).alias("score"))
    return graph.decayed_scores(P.graph(spark, sf_dir), seeds).select("node", F.round("score", 6).alias("score"))


@query(f"""WITH {P.GRAPH_SQL}, steps AS (SELECT source AS node, target AS neighbour, relation_id, relation_type, 'outgoing' AS direction FROM graph UNION ALL SELECT target, source, relation_id, relation_type, 'incoming' FROM graph),
roots AS (SELECT * FROM (SELECT c_mktsegment AS query_id, 'c' || c_custkey AS node, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, 'c' || c_custkey) AS sr FROM customer) WHERE sr <= 4),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY relation_type, relation_id, direction) AS rk FROM roots JOIN steps USING (node)),
taken AS (SELECT *, row_number() OVER (PARTITION BY query_id, neighbour ORDER BY sr, rk) = 1 AS first FROM near WHERE rk <= 6),
numbered AS (SELECT *, sum(first::INT) OVER (PARTITION BY query_id ORDER BY sr, rk) AS n FROM taken)
SELECT query_id, node AS seed, neighbour, relation_id, CASE WHEN NOT first THEN 'duplicate' WHEN n > 12 THEN 'limit' ELSE 'accepted' END AS status FROM numbered
UNION ALL SELECT query_id, node, neighbour, relation_id, 'limit' FROM near WHERE rk = 7""")
def graph_expansion(spark, sf_dir):
    seeds = P.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("query_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.col("c_acctbal").alias("score"))
    return graph.expand(P.graph(spark, sf_dir), seeds, 4, 6, 12)


@query(f"""WITH {P.SUPPLY_SQL} SELECT symbol_id, coalesce(ds, 0) AS distinct_sources, coalesce(n, 0) AS inbound, coalesce(fs, 0) AS files, coalesce(n - ds, 0) AS repeated, CASE WHEN n IS NULL THEN 'insufficient_evidence' ELSE 'not_evaluated' END AS status
FROM (SELECT 'p' || p_partkey AS symbol_id FROM part) LEFT JOIN (SELECT target, count(DISTINCT source) AS ds, count(*) AS n, count(DISTINCT file_id) AS fs FROM supply GROUP BY 1) ON target = symbol_id""")
def component_reuse(spark, sf_dir):
    parts = P.read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("symbol_id"))
    return graph.component_reuse(parts, P.supply(spark, sf_dir))


@query(f"""WITH {P.SUPPLY_SQL}, ends AS (SELECT target AS symbol_id, source AS neighbour, 1 AS i, 0 AS o FROM supply UNION ALL SELECT source, target, 0, 1 FROM supply),
c AS (SELECT symbol_id, count(DISTINCT neighbour) AS neighbours, count(DISTINCT CASE WHEN i = 1 THEN neighbour END) AS neighbours_in, count(DISTINCT CASE WHEN o = 1 THEN neighbour END) AS neighbours_out, sum(i)::BIGINT AS edges_in, sum(o)::BIGINT AS edges_out FROM ends GROUP BY 1)
SELECT symbol_id, coalesce(neighbours, 0) AS neighbours, coalesce(neighbours_in, 0) AS neighbours_in, coalesce(neighbours_out, 0) AS neighbours_out, coalesce(edges_in, 0) AS edges_in, coalesce(edges_out, 0) AS edges_out,
CASE WHEN neighbours IS NULL THEN 'insufficient_evidence' ELSE 'not_evaluated' END AS status FROM (SELECT 'p' || p_partkey AS symbol_id FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier) LEFT JOIN c USING (symbol_id)""")
def structural_centrality(spark, sf_dir):
    parts = P.read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("symbol_id"))
    suppliers = P.read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("symbol_id"))
    return graph.structural_centrality(parts.unionByName(suppliers), P.supply(spark, sf_dir))


@query(f"""WITH {P.SUPPLY_SQL} SELECT target AS symbol_id, count(DISTINCT source) AS distinct_sources, row_number() OVER (ORDER BY count(DISTINCT source) DESC, target) AS place FROM supply WHERE target IN (SELECT 'p' || p_partkey FROM part) GROUP BY 1 QUALIFY place <= 25""")
def top_components(spark, sf_dir):
    """The report of reuse: the parts that most suppliers supply, in its order."""
    from pyspark.sql.window import Window

    top = graph.top_patterns(component_reuse(spark, sf_dir), "distinct_sources", limit=25)
    # the few rows of the report, numbered as it has them
    return top.select("symbol_id", "distinct_sources", F.row_number().over(Window.orderBy(F.desc("distinct_sources"), "symbol_id")).cast("long").alias("place"))


@query(f"""WITH {_TRACES} SELECT root, relation_id, depth, status, row_number() OVER (PARTITION BY root ORDER BY depth, relation_type, CASE WHEN p.p_partkey IS NULL THEN '' WHEN p_size % 2 = 0 THEN 'oracle' ELSE 'powerbuilder' END,
coalesce(p_name, 'part' || coalesce(next, 0)), relation_id, node) AS place FROM traces LEFT JOIN part p ON p.p_partkey = next""")
def ordered_traces(spark, sf_dir):
    """Traces with their place in the output of their root."""
    named = P.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("symbol_id"), F.when(F.col("p_size") % 2 == 0, "oracle").otherwise("powerbuilder").alias("technology"), F.col("p_name").alias("name"))
    found = graph.ordered_edges(_traces(spark, sf_dir), named)
    return found.select("root", "relation_id", "depth", "status", F.col("place").cast("long").alias("place"))


@query(f"""WITH {P.SUPPLY_SQL}, t AS (SELECT target, relation_type, count(*) AS n FROM supply GROUP BY ALL)
SELECT target AS symbol_id, string_agg(relation_type || ':' || n, ',' ORDER BY relation_type) AS types FROM t GROUP BY 1""")
def relation_type_histogram(spark, sf_dir):
    found = graph.type_histogram(P.supply(spark, sf_dir), "target")
    return found.select("symbol_id", F.array_join(F.transform("types", lambda x: F.concat_ws(":", x["relation_type"], x["n"])), ",").alias("types"))


@query(f"""WITH {P.SUPPLY_SQL}, c AS (SELECT target, count(DISTINCT source) AS v FROM supply GROUP BY 1), r AS (SELECT v AS value, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM c),
p (share) AS (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) SELECT share, value FROM p JOIN r ON i = floor((n - 1) * share)""")
def pattern_percentiles(spark, sf_dir):
    counts = P.supply(spark, sf_dir).groupBy("target").agg(F.countDistinct("source").alias("v"))
    return inventory.lower_percentiles(counts, "v", [0.5, 0.75, 0.9, 1.0])


_RECORDS = f"records AS (SELECT doc_id AS record_id, source AS name, {_CONCEPTS_SQL} AS concepts FROM documents)"
_FREQUENCY = "f AS (SELECT concept, count(*) AS frequency, (SELECT count(*) FROM records) AS records FROM (SELECT DISTINCT record_id, unnest(concepts) AS concept FROM records) GROUP BY 1)"
_IDF = "CASE WHEN records <= 1 OR frequency <= 1 THEN 1.0 ELSE greatest(0.0, least(1.0, ln((records + 1.0) / (frequency + 0.5)) / ln((records + 1.0) / 1.5))) END"


def _records(spark, sf_dir):
    return P.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("name"), T.important_tokens(F.col("text"), STOPWORDS).alias("concepts"))


@query(f"WITH {_RECORDS}, {_FREQUENCY} SELECT concept, frequency, round({_IDF}, 6) AS idf FROM f")
def concept_idf(spark, sf_dir):
    found = retrieval.concept_frequency(_records(spark, sf_dir))
    return found.select("concept", "frequency", F.round(T.smoothed_idf(F.col("records"), F.col("frequency")), 6).alias("idf"))


@query(f"""WITH {_RECORDS}, {_FREQUENCY}, m AS (SELECT record_id, name, count(*) AS matched, max({_IDF}) AS rarity FROM (SELECT DISTINCT record_id, name, unnest(concepts) AS concept FROM records) JOIN f USING (concept) WHERE concept IN {tuple(CONCEPTS)} GROUP BY ALL)
SELECT record_id, matched, round(score, 6) AS score FROM (SELECT *, least(1.0, 0.30 * (matched / 5.0) + 0.15 * least(1.0, matched / 3.0) + 0.25 * rarity + 0.20 * 0.5 + CASE WHEN matched > 1 THEN 0.1 ELSE 0 END) AS score FROM m ORDER BY score DESC, record_id LIMIT 20)""")
def structured_score(spark, sf_dir):
    found = retrieval.structured_search(_records(spark, sf_dir), CONCEPTS, 20)
    return found.select("record_id", "matched", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT DISTINCT item_id AS q, doc_id AS item FROM documents JOIN benchmark b ON contains(documents.text, b.text)),
r AS (SELECT item_id AS q, doc_id AS item, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, n_chars FROM documents JOIN benchmark b ON contains(documents.text, substring(b.text, 1, 40))))
SELECT q AS question_id, round(count(*) FILTER (WHERE rank <= 5) / count(*), 6) AS recall_at_5, round(count(*) FILTER (WHERE rank <= 10) / count(*), 6) AS recall_at_10, round(coalesce(1.0 / min(rank), 0), 6) AS reciprocal_rank
FROM e LEFT JOIN r USING (q, item) GROUP BY 1""")
def recall_mrr(spark, sf_dir):
    """Benchmark items as questions: the documents that hold the whole item are expected, those that hold its first words are found."""
    docs, items = P.read(spark, sf_dir, "documents"), P.read(spark, sf_dir, "benchmark")
    found = _holding(docs, items.select(F.col("item_id").alias("question_id"), F.substring("text", 1, 40).alias("said"), F.col("text").alias("whole")))
    expected = found.filter(F.contains("text", F.col("whole"))).select("question_id", F.col("doc_id").alias("item"))
    from pyspark.sql.window import Window

    order = Window.partitionBy("question_id").orderBy(F.desc("n_chars"), "doc_id")
    ranked = found.select("question_id", F.col("doc_id").alias("item"), F.row_number().over(order).alias("rank"))
    out = evaluation.retrieval_metrics(ranked, expected)
    return out.select("question_id", *[F.round(c, 6).alias(c) for c in ("recall_at_5", "recall_at_10", "reciprocal_rank")])


def _holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with each item whose ``said`` they contain. The first column of items tells them apart.

    A text's words are looked up by each item's longest word of ``said`` between two others, so that texts meet items by an equi-join; one of one or two words is found as whole words. Only ids and words take part in
    it, and each text then comes once for each item that it may hold."""
    words = F.filter(F.split(F.col("said"), "[ \n]"), lambda w: w != "")
    inner = F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))).otherwise(words)
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    item = items.columns[0]
    held = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.col("text"), "[ \n]"))).alias("_key"))
    pairs = held.join(items.select(item, key.alias("_key")), "_key").select("doc_id", item).distinct()
    met = pairs.join(items, item).join(docs.select("doc_id", "n_chars", "text"), "doc_id")
    return met.filter(F.contains("text", F.col("said")))


@query(r"""WITH a AS (SELECT conv_id || '-' || turn AS answer_id, list_distinct(regexp_extract_all(text || ' [F' || (length(text) % 4) || '] [F' || (length(text) % 3) || ']', '\[(F\d+)\]', 1)) AS cited FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id || '-' || turn AS answer_id, CASE WHEN length(text) % 5 = 0 THEN ['F1'] ELSE ['F1', 'F2'] END AS allowed FROM conversations WHERE role = 'assistant'),
n AS (SELECT answer_id, len(cited) AS n_cited, len(list_filter(cited, lambda x: NOT list_contains(allowed, x))) AS n_unknown, len(list_filter(cited, lambda x: list_contains(allowed, x))) AS n_valid, len(list_filter(allowed, lambda x: NOT list_contains(cited, x))) AS n_unused FROM a JOIN s USING (answer_id))
SELECT *, CASE WHEN n_unknown > 0 THEN 'unknown_citation' WHEN n_valid = 0 THEN 'no_valid_citation' ELSE 'valid' END AS verdict FROM n""")
def citations_check(spark, sf_dir):
    """Assistant turns as answers, with marks by their length, against one or two allowed sources."""
    turns = P.read(spark, sf_dir, "conversations").filter("role = 'assistant'").withColumn("answer_id", F.concat_ws("-", "conv_id", "turn"))
    size = F.char_length("text")
    answers = turns.select("answer_id", F.concat("text", F.lit(" [F"), size % 4, F.lit("] [F"), size % 3, F.lit("]")).alias("text"))
    sources = turns.select("answer_id", F.explode(F.when(size % 5 == 0, F.array(F.lit("F1"))).otherwise(F.array(F.lit("F1"), F.lit("F2")))).alias("source_id"))
    return context.citation_report(answers, sources)


@query("""WITH u AS (SELECT l_shipmode AS model, l_quantity > 2 AS completed, l_discount < 0.09 AS accepted, l_discount AS score, l_extendedprice AS ms, l_quantity AS tokens FROM (SELECT *, l_suppkey % 7 AS l_shipmode FROM lineitem))
SELECT model, count(*) AS units, round(avg(completed::INT), 6) AS completion, round(avg(CASE WHEN completed THEN accepted::INT END), 6) AS acceptance, round(avg(CASE WHEN completed THEN score END), 6) AS mean_score,
round(median(CASE WHEN completed THEN ms END), 6) AS median_ms, sum(CASE WHEN completed THEN tokens END) AS tokens FROM u GROUP BY 1""")
def model_aggregates(spark, sf_dir):
    """Line items as scored units of seven models."""
    units = P.read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("model"),
        (F.col("l_quantity") > 2).alias("completed"),
        (F.col("l_discount") < 0.09).cast("int").alias("accepted"),
        F.col("l_discount").alias("score"),
        F.col("l_extendedprice").alias("duration_ms"),
        F.col("l_quantity").alias("tokens"),
    )
    return evaluation.model_aggregates(units)


@query("""WITH e AS (SELECT user_id AS target, CASE WHEN event_id % 2 = 0 THEN 'no_training' ELSE 'retention' END AS c, value, value < 90 AS valid, CASE WHEN event_type = 'error' OR value > 80 THEN 'fail' ELSE 'pass' END AS v FROM events),
k AS (SELECT target, c, count(*) FILTER (WHERE valid AND v = 'pass') AS good, count(*) FILTER (WHERE valid AND v = 'fail') AS bad FROM e GROUP BY ALL),
s AS (SELECT target, max(CASE WHEN c = 'no_training' THEN st END) AS nt, max(CASE WHEN c = 'retention' THEN st END) AS rt FROM (SELECT *, CASE WHEN good > 0 AND bad > 0 THEN 'unknown' WHEN bad > 0 THEN 'fail' WHEN good > 0 THEN 'pass' ELSE 'unknown' END AS st FROM k) GROUP BY 1),
t AS (SELECT DISTINCT user_id AS target, CASE user_id % 10 WHEN 0 THEN 'local' WHEN 1 THEN 'unknown' ELSE 'remote' END AS execution FROM events)
SELECT target, execution, CASE WHEN execution = 'local' THEN 'not_applicable' WHEN execution = 'unknown' OR coalesce(nt, 'unknown') <> 'pass' THEN 'block' WHEN rt = 'pass' THEN 'pass' ELSE 'warning' END AS decision FROM t LEFT JOIN s USING (target)""")
def privacy_decision(spark, sf_dir):
    """Users as targets, events as evidence."""
    events = P.read(spark, sf_dir, "events")
    evidence = events.select(
        F.col("user_id").alias("target"),
        F.when(F.col("event_id") % 2 == 0, "no_training").otherwise("retention").alias("constraint"),
        F.when((F.col("event_type") == "error") | (F.col("value") > 80), "fail").otherwise("pass").alias("value"),
        (F.col("value") < 90).alias("valid"),
    )
    kind = F.when(F.col("user_id") % 10 == 0, "local").when(F.col("user_id") % 10 == 1, "unknown").otherwise("remote")
    targets = events.select(F.col("user_id").alias("target"), kind.alias("execution")).distinct()
    return evaluation.privacy_decision(targets, evaluation.constraint_status(evidence))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def json_properties(spark, sf_dir):
    return P.read(spark, sf_dir, "events").select("event_id", F.coalesce(T.json_or_empty(F.col("props"))["k"], F.lit("")).alias("k"))


@query(f"WITH {_COSINE} SELECT label, round(avg(score), 6) AS mean_score, round(max(score), 6) AS best FROM scored GROUP BY 1")
def vector_label_profile(spark, sf_dir):
    q = P.query_vector(spark, sf_dir)
    score = V.cosine(F.col("embedding"), F.array(*map(F.lit, q)))
    return P.vectors(spark, sf_dir).groupBy("label").agg(F.round(F.avg(score), 6).alias("mean_score"), F.round(F.max(score), 6).alias("best"))


@query()
def chunk_documents(spark, sf_dir):
    docs = P.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return context.chunk_documents(docs).select("document_id", "ordinal", "start_char", "end_char", "sha256", "chunk_id")


@query()
def context_budget(spark, sf_dir):
    """Each benchmark item as a question: the 50 best of the documents that hold the item, packed into a context of 2,000 tokens. Ranks are made of rows without texts."""
    docs, items = P.read(spark, sf_dir, "documents"), P.read(spark, sf_dir, "benchmark")
    found = _holding(docs, items.select(F.col("item_id").alias("query_id"), F.col("text").alias("said")))
    from pyspark.sql.window import Window

    scored = found.select("query_id", F.col("doc_id").alias("chunk_id"), T.keyword_score(F.col("text"), TOKENS).alias("score"))
    best = scored.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).filter("_k <= 50").drop("_k")
    texts = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    rows = best.join(texts, "chunk_id").select("query_id", "chunk_id", F.sha2("content", 256).alias("sha256"), "score", F.col("chunk_id").alias("document_id"), F.lit(0).alias("ordinal"), "content")
    return context.select_context(rows, 2000, 0.2).select("query_id", "chunk_id", "source", "decision", "tokens")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# these modules add their queries to the registry
from tracewell.plans import configurations, contexts, evidence, specifications  # noqa: E402, F401

"""The engine's tables as views of the given ones: documents are chunks, the star schema is a dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (chunk_id, relative_path, ordinal, content, document_id, domain, artifact_kind)."""
    path = F.concat_ws("/", F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        path.alias("relative_path"),
        F.lit(0).alias("ordinal"),
        F.col("text").alias("content"),
        F.col("doc_id").alias("document_id"),
        F.col("lang").alias("domain"),
        F.lit("text").alias("artifact_kind"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector, as the question's."""
    row = read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row.embedding] if row else []


def _node(kind: str, key: str):
    return F.concat(F.lit(kind), F.col(key).cast("string"))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (source, target, relation_id, relation_type, file_id): orders use customers, customers and suppliers refer to nations,
    nations to regions."""
    edge = lambda df, s, t, kind, file: df.select(s.alias("source"), t.alias("target"), F.lit(kind).alias("relation_type"), file.cast("long").alias("file_id"))
    orders, customer, supplier, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "supplier", "nation"))
    out = edge(orders, _node("o", "o_orderkey"), _node("c", "o_custkey"), "uses", F.col("o_orderkey"))
    out = out.unionByName(edge(customer, _node("c", "c_custkey"), _node("n", "c_nationkey"), "references", F.col("c_custkey")))
    out = out.unionByName(edge(supplier, _node("s", "s_suppkey"), _node("n", "s_nationkey"), "references", F.col("s_suppkey")))
    out = out.unionByName(edge(nation, _node("n", "n_nationkey"), _node("r", "n_regionkey"), "parent_of", F.col("n_nationkey")))
    return out.withColumn("relation_id", F.concat_ws(">", "source", "target"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's nodes as (symbol_id, symbol_type)."""
    parts = [
        read(spark, sf_dir, table).select(_node(letter, key).alias("symbol_id"), F.lit(table).alias("symbol_type"))
        for table, letter, key in (("orders", "o", "o_orderkey"), ("customer", "c", "c_custkey"), ("supplier", "s", "s_suppkey"), ("nation", "n", "n_nationkey"), ("region", "r", "r_regionkey"))
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with cycles from parts: source, target, relation_id, relation_type, resolution_status, technology, target_key. Part k leads to k // 3 and, every fourth, to k // 2, every
    fifth to 3 k, which leads back; every seventh names a part that is not there, every eleventh one that is not clear."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), (F.col("p_size") % 2).alias("t"))
    technology = F.when(F.col("t") == 0, "oracle").otherwise("powerbuilder").alias("technology")
    row = lambda keep, target, kind, status: part.filter(keep).select(F.col("k").alias("source"), target.cast("long").alias("target"), F.concat(F.lit(kind[0]), F.col("k")).alias("relation_id"), F.lit(kind).alias("relation_type"), F.lit(status).alias("resolution_status"), technology, F.concat(F.lit("part"), F.coalesce(target, F.lit(0)).cast("string")).alias("target_key"))
    third = F.floor(F.col("k") / 3)
    out = row("k >= 3", third, "calls", "resolved").unionByName(row("k % 4 = 0", F.floor(F.col("k") / 2), "uses", "resolved"))
    out = out.unionByName(row("k % 5 = 0", F.col("k") * 3, "opens", "resolved"))
    return out.unionByName(row("k % 7 = 0", F.lit(None).cast("long"), "references", "unresolved")).unionByName(row("k % 11 = 0", F.lit(None).cast("long"), "parent_of", "ambiguous"))


#: The same in SQL.
RING_SQL = """ring AS (
  SELECT p_partkey::BIGINT AS source, (p_partkey // 3)::BIGINT AS target, 'c' || p_partkey AS relation_id, 'calls' AS relation_type, 'resolved' AS resolution_status, p_size % 2 AS t FROM part WHERE p_partkey >= 3
  UNION ALL SELECT p_partkey, p_partkey // 2, 'u' || p_partkey, 'uses', 'resolved', p_size % 2 FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, p_partkey * 3, 'o' || p_partkey, 'opens', 'resolved', p_size % 2 FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT p_partkey, NULL, 'r' || p_partkey, 'references', 'unresolved', p_size % 2 FROM part WHERE p_partkey % 7 = 0
  UNION ALL SELECT p_partkey, NULL, 'p' || p_partkey, 'parent_of', 'ambiguous', p_size % 2 FROM part WHERE p_partkey % 11 = 0)"""


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges supplier to part from lineitem: source, target, file_id (the order), relation_type."""
    return read(spark, sf_dir, "lineitem").select(
        _node("s", "l_suppkey").alias("source"), _node("p", "l_partkey").alias("target"), F.col("l_orderkey").alias("file_id"), F.col("l_returnflag").alias("relation_type")
    )


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as PL/SQL scripts (document_id, text, n): a package body with a procedure of four lines for each item, that reads the part's table and calls the supplier's package
    and, for every third item, the order's first procedure. n is the number of items."""
    # an order's items are sorted by themselves, after one shuffle of their numbers
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("i")).repartition("l_orderkey")
    orders = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("i")).alias("p"), F.count(F.lit(1)).alias("n"))
    name = F.concat(F.lit("pkg"), F.col("l_orderkey"))

    def procedure(item, i):
        number = (i + 1).cast("string")
        calls = F.when((i + 1) % 3 == 0, F.concat(name, F.lit(".run1(x);"))).otherwise(F.concat(F.lit("sup"), item["l_suppkey"], F.lit(".ship (x);")))
        return F.concat(
            F.lit("  PROCEDURE run"), number, F.lit(" IS BEGIN -- from nowhere\n    SELECT 'from text' INTO x FROM part"), item["l_partkey"], F.lit(";\n    "), calls, F.lit("\n  END run"), number, F.lit(";")
        )

    text = F.concat(F.lit("CREATE OR REPLACE PACKAGE BODY "), name, F.lit(" IS\n"), F.array_join(F.transform("p", procedure), "\n"), F.lit("\nEND "), name, F.lit(";"))
    return orders.select(F.col("l_orderkey").alias("document_id"), text.alias("text"), "n")


#: The items of the scripts in SQL.
SCRIPTS_SQL = "items AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)"
#: The graph and its nodes in SQL, as common table expressions.
GRAPH_SQL = """
edges AS (
  SELECT 'o' || o_orderkey AS source, 'c' || o_custkey AS target, 'uses' AS relation_type, o_orderkey::BIGINT AS file_id FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'references', c_custkey::BIGINT FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'references', s_suppkey::BIGINT FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'parent_of', n_nationkey::BIGINT FROM nation),
graph AS (SELECT *, source || '>' || target AS relation_id FROM edges),
symbols AS (
  SELECT 'o' || o_orderkey AS symbol_id, 'orders' AS symbol_type FROM orders UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'region' FROM region)"""
SUPPLY_SQL = "supply AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_orderkey AS file_id, l_returnflag AS relation_type FROM lineitem)"
CHUNKS_SQL = "chunks AS (SELECT doc_id AS chunk_id, source || '/' || doc_id || '.txt' AS relative_path, 0 AS ordinal, text AS content, lang AS domain FROM documents)"

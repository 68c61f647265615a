"""Queries over declarative configuration: customers as the DML statements of their nation's script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import configuration as C
from tracewell.plans import tables as P
from tracewell.plans.registry import query
from tracewell.sources import configuration as S

#: The declared columns of the configuration that the scripts fill.
_COLUMNS = [("table", "cfg.rules"), ("identity", "rule_id"), ("name", "title"), ("formula", "formula"), ("variable", "seg"), ("parent", "owner_id"), ("status", "state")]
_PATTERNS = [("rules", r"\[@([^\]]+)\]", 1), ("rules", r"\[%([^\]]+)\]", 1)]


def declarations(spark) -> DataFrame:
    rows = [("rules", role, column, i, "rules" if role == "parent" else None, None, None, None, ["A"] if role == "status" else None, ["I"] if role == "status" else None) for i, (role, column) in enumerate(_COLUMNS)]
    return spark.createDataFrame(
        rows, "configuration string, role string, column_name string, position int, target_configuration string, target_technology string, target_type string, relation_type string, values_active array<string>, values_inactive array<string>"
    )


def patterns(spark) -> DataFrame:
    return spark.createDataFrame(_PATTERNS, "configuration string, pattern string, token_group int")


def scripts(spark, sf_dir: str) -> DataFrame:
    """A script for each nation: a block, then a statement for each customer: inserts, updates, and four kinds that are no records."""
    k, part = F.col("c_custkey"), lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    owner = F.when(k % 50 == 5, 2 * k).otherwise(F.floor(k / 2))
    formula = F.when(k % 3 == 0, part("[@", F.col("c_mktsegment"), "] + ROUND([%rate] * F", F.col("c_nationkey"), "(x))")).when(k % 3 == 1, part("F", F.col("c_nationkey"), "(x || y)")).otherwise(F.lit("TRUNC([@MACHINERY])"))
    state = F.when(k % 4 == 0, "I").otherwise("A")
    insert = part("INSERT INTO cfg.rules (rule_id, title, formula, seg, owner_id, state)\n  VALUES (", k, ", '", F.col("c_name"), "; it''s', '", formula, "', '", F.col("c_mktsegment"), "', ", owner, ", '", state, "')")
    update = part("update RULES set state = 'I', title = 'new' where rule_id = ", k)
    text = F.when(k % 10 == 6, update).when(k % 10 == 7, part("INSERT INTO rules (rule_id, title) VALUES (", k, ")")).when(k % 10 == 8, "INSERT INTO rules SELECT * FROM old").when(k % 10 == 9, part("INSERT INTO other (a) VALUES (", k, ")")).otherwise(insert)
    each = P.read(spark, sf_dir, "customer").select("c_nationkey", F.struct(k, text.alias("t")).alias("s"))
    whole = each.groupBy(F.col("c_nationkey").alias("document_id")).agg(F.array_sort(F.collect_list("s")).alias("_s"))
    return whole.select("document_id", F.concat(F.lit("BEGIN\n  x := 1;\nEND;\n"), F.array_join(F.transform("_s", lambda x: F.concat(x["t"], F.lit(";"))), "\n")).alias("text"))


_SQL = """k AS (SELECT *, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 2 AS ordinal FROM customer),
read AS (
  SELECT c_nationkey AS document_id, ordinal, k, c_name, c_mktsegment, k % 10 = 6 AS partial, CASE WHEN k % 50 = 5 THEN 2 * k ELSE k // 2 END AS owner,
    CASE k % 10 WHEN 7 THEN 'column_value_mismatch' WHEN 8 THEN 'unsupported_insert' WHEN 9 THEN 'undeclared_table' END AS reason FROM k),
records AS (SELECT * FROM read WHERE reason IS NULL),
diagnostics AS (
  SELECT document_id, ordinal, 'insert' AS statement_type, reason, CASE WHEN reason = 'column_value_mismatch' THEN 'error' ELSE 'warning' END AS severity FROM read WHERE reason IS NOT NULL
  UNION ALL SELECT DISTINCT c_nationkey, 1, 'plsql_block', 'unsupported_statement', 'warning' FROM customer)"""


@query(f"""WITH {_SQL} SELECT document_id, ordinal::INT AS ordinal, CASE WHEN partial THEN 'update' ELSE 'insert' END AS operation, NULL AS reason, 'rules.' || k AS name, CASE WHEN partial THEN 3 ELSE 6 END AS n FROM records
UNION ALL SELECT document_id, ordinal, statement_type, reason, severity, 0 FROM diagnostics""")
def configuration_records(spark, sf_dir):
    """Every statement: a record with its values counted, or the reason that it is none."""
    records, diagnostics = S.read_configurations(scripts(spark, sf_dir), declarations(spark))
    key = F.filter("values", lambda v: v["is_identity"])[0]["raw"]
    told = records.select("document_id", "ordinal", "operation", F.lit(None).cast("string").alias("reason"), F.concat_ws(".", "configuration", key).alias("name"), F.size("values").alias("n"))
    return told.unionByName(diagnostics.select("document_id", "ordinal", F.col("statement_type").alias("operation"), "reason", F.col("severity").alias("name"), F.lit(0).alias("n")))


@query(f"""WITH {_SQL}, named AS (SELECT *, 'rules.' || k AS name, CASE WHEN partial OR k % 4 = 0 THEN 'stale' ELSE 'active' END AS state FROM records)
SELECT 'rules' AS normalized_name, 'rules' AS original_name, 'configuration_entity' AS symbol_type, NULL AS container, 'high' AS confidence, 'active' AS status FROM (SELECT count(*) FROM records HAVING count(*) > 0)
UNION ALL SELECT name, CASE WHEN partial THEN 'new' ELSE c_name || '; it''s' END, 'configuration_record', 'rules', CASE WHEN partial THEN 'medium' ELSE 'high' END, state FROM named
UNION ALL SELECT name || '.configuration_formula.formula', 'formula', 'configuration_formula', name, 'medium', state FROM named WHERE NOT partial
UNION ALL SELECT name || '.configuration_variable.seg', 'seg', 'configuration_variable', name, 'medium', state FROM named WHERE NOT partial""")
def configuration_symbols(spark, sf_dir):
    records, _ = S.read_configurations(scripts(spark, sf_dir), declarations(spark))
    symbols, _ = C.configuration_symbols(records, declarations(spark))
    return symbols.select("normalized_name", "original_name", "symbol_type", "container", "confidence", "status")


@query(f"""WITH {_SQL}, full_ AS (SELECT *, k % 3 = 1 AS dynamic, 'f' || document_id AS f FROM records WHERE NOT partial)
SELECT document_id, ordinal::INT AS ordinal, owner || '' AS raw_text, 'rules.' || owner AS normalized_target, 'parent_of' AS reference_type, 'configuration' AS technology, 'high' AS confidence, 'unresolved' AS resolution_status, NULL AS token_kind, false AS external FROM full_
UNION ALL SELECT document_id, ordinal, c_mktsegment, 'rules.' || lower(c_mktsegment), 'configuration_token', 'configuration', 'high', 'unresolved', 'variable', false FROM full_ WHERE k % 3 = 0
UNION ALL SELECT document_id, ordinal, 'rate', 'rules.rate', 'configuration_token', 'configuration', 'high', 'unresolved', 'parameter', false FROM full_ WHERE k % 3 = 0
UNION ALL SELECT document_id, ordinal, 'MACHINERY', 'rules.machinery', 'configuration_token', 'configuration', 'high', 'unresolved', 'variable', false FROM full_ WHERE k % 3 = 2
UNION ALL SELECT document_id, ordinal, 'ROUND', 'round', 'function_candidate', 'unknown', 'medium', 'unresolved', 'function_candidate', true FROM full_ WHERE k % 3 = 0
UNION ALL SELECT document_id, ordinal, 'TRUNC', 'trunc', 'function_candidate', 'unknown', 'medium', 'unresolved', 'function_candidate', true FROM full_ WHERE k % 3 = 2
UNION ALL SELECT document_id, ordinal, upper(f), f, 'function_candidate', 'unknown', CASE WHEN dynamic THEN 'low' ELSE 'medium' END, CASE WHEN dynamic THEN 'dynamic' ELSE 'unresolved' END, 'function_candidate', false FROM full_ WHERE k % 3 < 2""")
def configuration_references(spark, sf_dir):
    records, _ = S.read_configurations(scripts(spark, sf_dir), declarations(spark))
    found = C.configuration_references(records, declarations(spark), patterns(spark))
    return found.select("document_id", "ordinal", "raw_text", "normalized_target", "reference_type", "technology", "confidence", "resolution_status", "token_kind", "external")


@query(f"""WITH RECURSIVE {_SQL}, chain AS (SELECT k, CASE WHEN NOT partial AND owner IN (SELECT k FROM records) THEN owner END AS up FROM records),
walk AS (
  SELECT k, k AS here, 0::BIGINT AS depth, [k] AS path, false AS cyclic FROM chain
  UNION ALL SELECT w.k, c.up, w.depth + 1, list_append(w.path, c.up), list_contains(w.path, c.up) FROM walk w JOIN chain c ON c.k = w.here WHERE c.up IS NOT NULL AND NOT w.cyclic),
ended AS (SELECT k, arg_max(here, depth) AS root, max(depth) AS depth, bool_or(cyclic) AS cyclic, arg_max(path, depth) AS path FROM walk GROUP BY k)
SELECT 'rules.' || k AS name, CASE WHEN NOT cyclic THEN 'rules.' || root END AS root, CASE WHEN NOT cyclic THEN depth END AS depth, 'rules.' || list_filter(path, lambda x: x % 4 = 0)[1] AS nearest, cyclic FROM ended""")
def configuration_lineage(spark, sf_dir):
    """The chain of owners that records name: roots, depths, the nearest of every fourth, cycles."""
    records, _ = S.read_configurations(scripts(spark, sf_dir), declarations(spark))
    value = lambda column: F.get(F.transform(F.filter("values", lambda v: v["column"] == column), lambda v: v["raw"]), 0).cast("long")
    rows = records.select(value("rule_id").alias("k"), value("owner_id").alias("up"))
    name = lambda c: F.concat(F.lit("rules."), F.col(c))
    symbols = rows.select(name("k").alias("symbol_id"), name("up").alias("parent_id"), F.when(F.col("k") % 4 == 0, "configuration_record").otherwise("configuration_step").alias("symbol_type"))
    found = C.lineage(symbols)
    return found.select(F.col("symbol_id").alias("name"), F.col("root_id").alias("root"), "depth", F.col("nearest_id").alias("nearest"), "cyclic")


@query(f"""WITH {_SQL}, a AS (SELECT document_id, count(*) AS records, count(*) FILTER (WHERE partial) AS partial FROM records GROUP BY 1),
b AS (SELECT document_id, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'error') AS errors FROM diagnostics GROUP BY 1)
SELECT document_id, coalesce(records, 0) AS records, coalesce(partial, 0) AS partial, warnings, errors FROM b LEFT JOIN a USING (document_id)""")
def configuration_metrics(spark, sf_dir):
    found = scripts(spark, sf_dir)
    return S.configuration_metrics(found, *S.read_configurations(found, declarations(spark)))


@query("SELECT DISTINCT c_nationkey AS document_id, 'rules' AS configurations FROM customer WHERE c_nationkey % 3 = 1 AND c_custkey % 10 <> 9")
def configuration_files(spark, sf_dir):
    """Scripts by their path and the tables that their DML names."""
    files = scripts(spark, sf_dir).withColumn("relative_path", F.concat(F.when(F.col("document_id") % 3 == 1, "cfg/").otherwise("src/"), "document_id", F.lit(".SQL")))
    found = S.configuration_scripts(files, declarations(spark), "cfg/%")
    return found.select("document_id", F.array_join("configurations", ",").alias("configurations"))

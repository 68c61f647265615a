"""Symbols of declarative configuration, their lineage, and the references that declared columns and formulas make."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.plans.materialize import written
from tracewell.sources.configuration import identifier

#: The symbols that columns of a role make.
DERIVED = {
    "rule": "configuration_rule", "formula": "configuration_formula", "variable": "configuration_variable", "parameter": "configuration_parameter", "mapping": "configuration_mapping", "step": "configuration_step",
}
#: Functions that no catalog of a project holds.
EXTERNAL = ("abs", "ceil", "coalesce", "decode", "floor", "greatest", "least", "lower", "nvl", "nullif", "power", "round", "substr", "to_char", "to_date", "trunc", "upper")
#: Relation types that a declaration may name, and the reference types of target types.
RELATIONS = ("precedes", "parent_of", "calls", "uses")
TARGET_TYPES = {"calls": ("procedure", "function", "event", "function_object"), "table": ("table", "view", "datawindow")}


def shown(raw: Column) -> Column:
    """A value without the quotes around it, as far as that leaves anything."""
    bare = F.btrim(raw)
    quoted = (F.char_length(bare) >= 2) & F.startswith(bare, F.lit("'")) & F.endswith(bare, F.lit("'"))
    inner = F.btrim(F.when(quoted, F.replace(F.substring(bare, F.lit(2), F.char_length(bare) - 2), F.lit("''"), F.lit("'"))).otherwise(bare))
    return F.when(inner == "", raw).otherwise(inner)


def name_part(value: Column) -> Column:
    """A value as a part of a name: other characters than letters, digits, _, $ and # become one underscore."""
    safe = F.btrim(F.regexp_replace(F.btrim(value), "[^A-Za-z0-9_$#]+", "_"), F.lit("_"))
    return F.when(safe == "", "value").otherwise(safe)


def _symbol_id(name: Column, kind: Column, container: Column) -> Column:
    return T.deterministic_id(name, kind, F.lit("configuration"), container)


def _record_name(records: DataFrame) -> DataFrame:
    """Adds _name and _id of each record's symbol."""
    told = F.array_join(F.transform(F.filter("values", lambda v: v["is_identity"]), lambda v: name_part(shown(v["raw"]))), ".")
    named = records.withColumn("_name", T.symbol_name(F.concat_ws(".", "configuration", told)))
    return named.withColumn("_id", _symbol_id(F.col("_name"), F.lit("configuration_record"), F.col("configuration")))


def _of_role(declarations: DataFrame, *roles: str) -> DataFrame:
    return declarations.filter(F.col("role").isin(*roles)).withColumn("column", identifier(F.col("column_name")))


def _values(records: DataFrame) -> DataFrame:
    """A row per value of a record that is not null."""
    each = records.select("*", F.explode("values").alias("_v")).select("*", F.col("_v.column").alias("column"), F.col("_v.raw").alias("raw"), F.col("_v.value_type").alias("value_type")).drop("_v")
    return each.filter("value_type != 'null'")


def configuration_symbols(records: DataFrame, declarations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols, and diagnostics (document_id, ordinal, record_id, reason) of records that come again.

    Symbols: symbol_id, parent_id, container, normalized_name, original_name, symbol_type, confidence, status, document_id, start_line, end_line. A configuration has an entity, a record is its child, and a record's columns of the roles in DERIVED are
    children of the record. Confidence is medium for columns and for records of UPDATEs, which tell a part. A record is stale if a column of the role ``status`` has one of its inactive values (``values_active``, ``values_inactive``: arrays, compared
    without case; the first column that has either decides); its children share that. Of a symbol's rows the first by document and statement stays.
    """
    named = _record_name(records)
    at = F.struct("document_id", "ordinal", "column", "raw")
    status = _of_role(declarations, "status").select("configuration", "column", F.col("position").alias("_p"), *[F.transform(x, lambda v: F.lower(F.btrim(v, F.lit(" '")))).alias(x) for x in ("values_active", "values_inactive")])
    said = named.select("configuration", "document_id", "ordinal", F.explode("values").alias("_v")).select("configuration", "document_id", "ordinal", F.col("_v.column").alias("column"), F.lower(shown(F.col("_v.raw"))).alias("_s"))
    judged = said.join(status, ["configuration", "column"]).withColumn("_state", F.when(F.array_contains("values_active", F.col("_s")), "active").when(F.array_contains("values_inactive", F.col("_s")), "stale")).filter("_state is not null")
    states = judged.groupBy("document_id", "ordinal").agg(F.min_by("_state", "_p").alias("_state"))
    names = _of_role(declarations, "name").select("configuration", "column", F.col("position").alias("_p"))
    titles = named.select("configuration", "document_id", "ordinal", F.explode("values").alias("_v")).select("configuration", "document_id", "ordinal", F.col("_v.column").alias("column"), shown(F.col("_v.raw")).alias("_t"))
    titles = titles.join(names, ["configuration", "column"]).groupBy("document_id", "ordinal").agg(F.min_by("_t", "_p").alias("_title"))
    told = named.join(states, ["document_id", "ordinal"], "left").join(titles, ["document_id", "ordinal"], "left").withColumn("status", F.coalesce("_state", F.lit("active")))
    told = told.withColumn("_entity", _symbol_id(T.symbol_name(F.col("configuration")), F.lit("configuration_entity"), F.lit(None)))

    text = F.lit(None).cast("string")
    identity = F.array_join(F.transform(F.array_sort(F.filter("values", lambda v: v["is_identity"])), lambda v: shown(v["raw"])), ".")
    row = lambda df, column, raw, **c: df.select(*[v.alias(k) for k, v in c.items()], "document_id", "ordinal", "start_line", "end_line", column.alias("column"), raw.alias("raw"))
    entities = row(told, text, text, symbol_id=F.col("_entity"), parent_id=text, container=text, normalized_name=T.symbol_name(F.col("configuration")), original_name=F.col("configuration"), symbol_type=F.lit("configuration_entity"), confidence=F.lit("high"), status=F.lit("active"))
    own = row(told, text, text, symbol_id=F.col("_id"), parent_id=F.col("_entity"), container=T.symbol_name(F.col("configuration")), normalized_name=F.col("_name"), original_name=F.coalesce("_title", identity), symbol_type=F.lit("configuration_record"),
              confidence=F.when(F.col("partial"), "medium").otherwise("high"), status=F.col("status"))
    kinds = F.create_map(*[F.lit(x) for pair in DERIVED.items() for x in pair])
    roles = _of_role(declarations, *DERIVED).select("configuration", "column", kinds[F.col("role")].alias("symbol_type"), F.col("column_name"))
    parts = _values(told).join(roles, ["configuration", "column"]).withColumn("_n", T.symbol_name(F.concat_ws(".", "_name", "symbol_type", "column_name")))
    derived = row(parts, F.col("column"), F.col("raw"), symbol_id=_symbol_id(F.col("_n"), F.col("symbol_type"), F.col("_name")), parent_id=F.col("_id"), container=F.col("_name"), normalized_name=F.col("_n"), original_name=F.col("column_name"),
                  symbol_type=F.col("symbol_type"), confidence=F.lit("medium"), status=F.col("status"))
    every = entities.unionByName(own).unionByName(derived)
    columns = [c for c in every.columns if c not in ("symbol_id", "ordinal", "column", "raw")]
    first = every.groupBy("symbol_id").agg(F.min_by(F.struct(*columns), at).alias("_f")).select("symbol_id", "_f.*")
    place = F.struct("document_id", "ordinal")
    starts = records.groupBy("record_id").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = records.join(starts, "record_id").filter(place > F.col("_first")).select("document_id", "ordinal", "record_id", F.lit("duplicate_record").alias("reason"))
    return first, again


def lineage(symbols: DataFrame, nearest: str = "configuration_record") -> DataFrame:
    """Of each symbol: root_id, depth (steps to it), nearest_id (the closest symbol of the given type, itself included) and cyclic.

    symbols: symbol_id, parent_id, symbol_type. A parent that is no symbol ends the chain. Pointers are doubled: after k rounds each symbol knows 2**k steps, so the rounds grow with the logarithm of the
    longest chain, and a chain that still goes on after more steps than there are symbols leads into a cycle: cyclic, without root and depth. Each round is one join and is written. Repeated ids: the least parent.
    """
    base = symbols.groupBy("symbol_id").agg(F.min("parent_id").alias("parent_id"), F.min("symbol_type").alias("symbol_type"))
    there = base.select(F.col("symbol_id").alias("parent_id"), F.lit(True).alias("_there"))
    rows = base.join(there, "parent_id", "left").withColumn("up", F.when(F.col("_there"), F.col("parent_id")))
    own = F.when(F.col("symbol_type") == nearest, F.col("symbol_id"))
    # up: the symbol 2**k steps on; last, depth: the furthest one known and its distance; near: the nearest one before up
    now = written(rows.select("symbol_id", "up", F.coalesce("up", "symbol_id").alias("last"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), own.alias("near")), "lineage")
    most = max(now.count(), 1)
    for _ in range(math.ceil(math.log2(most)) + 1):
        if now.filter("up is not null").isEmpty():
            break
        ahead = now.select(F.col("symbol_id").alias("up"), F.col("up").alias("_up"), F.col("last").alias("_last"), F.col("depth").alias("_depth"), F.col("near").alias("_near"))
        joined = now.filter("up is not null").join(ahead, "up")
        stepped = joined.select("symbol_id", F.col("_up").alias("up"), F.col("_last").alias("last"), (F.col("depth") + F.col("_depth")).alias("depth"), F.coalesce("near", "_near").alias("near"))
        now = written(now.filter("up is null").unionByName(stepped), "lineage")
    cyclic = F.col("up").isNotNull()
    return now.select("symbol_id", F.when(~cyclic, F.col("last")).alias("root_id"), F.when(~cyclic, F.col("depth")).alias("depth"), F.col("near").alias("nearest_id"), cyclic.alias("cyclic"))


def expression_tokens(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """What patterns find in expressions: (the columns of values but expression, token, kind), each token and kind once.

    values: configuration and keys, expression. patterns: configuration, pattern (a regular expression of Java), token_group (the group that holds the token, 0: all of it), in any number: they are data. A token found in [@ ] is a variable and
    one in [% ] a parameter; kind is null for others. Blank tokens are none.
    """
    keys = [c for c in values.columns if c != "expression"]
    met = values.join(patterns.select("configuration", "pattern", "token_group"), "configuration")
    whole = F.regexp_extract_all("expression", F.col("pattern"), F.lit(0))
    inner = F.when(F.col("token_group") > 0, F.regexp_extract_all("expression", F.col("pattern"), F.col("token_group"))).otherwise(whole)
    found = met.select(*keys, F.explode(F.arrays_zip(whole.alias("w"), inner.alias("t"))).alias("_z"))
    start = F.ltrim("_z.w")
    kind = F.when(F.startswith(start, F.lit("[@")), "variable").when(F.startswith(start, F.lit("[%")), "parameter")
    token = F.btrim(F.when(F.btrim("_z.t") == "", F.col("_z.w")).otherwise(F.col("_z.t")))
    return found.select(*keys, token.alias("token"), kind.alias("kind")).filter("token != ''").distinct()


def _dynamic_value(value: Column) -> Column:
    held = [F.contains(value, F.lit(x)) for x in ("||", "{", "}")]
    return held[0] | held[1] | held[2] | F.startswith(value, F.lit(":")) | F.startswith(value, F.lit("&"))


def _dynamic_expression(text: Column) -> Column:
    count = lambda x: F.char_length(text) - F.char_length(F.replace(text, F.lit(x)))
    return F.contains(text, F.lit("||")) | (count("(") != count(")")) | (count("{") != count("}"))


def _target_value(raw: Column) -> Column:
    value = shown(raw)
    braces = F.startswith(value, F.lit("${")) & F.endswith(value, F.lit("}"))
    return F.when(braces, F.substring(value, F.lit(3), F.char_length(value) - 3)).when(F.startswith(value, F.lit(":")) | F.startswith(value, F.lit("&")), F.substring(value, F.lit(2), F.char_length(value))).otherwise(value)


def configuration_references(records: DataFrame, declarations: DataFrame, patterns: DataFrame) -> DataFrame:
    """References of records: (document_id, ordinal, source_id, column, raw_text, normalized_target, reference_type, technology, confidence, resolution_status, token_kind, external), each once a record.

    Columns of the role ``reference`` (with target_configuration, target_technology, target_type, relation_type) and ``parent`` (target_configuration) refer to their value; it is dynamic, and of low confidence, if it is put together or a placeholder. In columns of the
    roles ``formula`` and ``rule`` the patterns' tokens refer to names of the configuration; a token that one of variable and parameter columns of the record holds is of that kind. NAME( in a formula is a candidate for a function. Nulls refer to nothing.
    """
    named = _record_name(records).withColumn("source_id", F.col("_id"))
    values = _values(named).select("document_id", "ordinal", "source_id", "configuration", "column", "raw").withColumn("expression", shown(F.col("raw")))
    roles = _of_role(declarations, "reference", "parent").select("configuration", "column", "role", "target_configuration", "target_technology", "target_type", "relation_type")
    declared = values.join(roles, ["configuration", "column"])
    target, dynamic = _target_value(F.col("raw")), _dynamic_value(F.col("expression"))
    kind = F.regexp_replace(F.lower(F.btrim("target_type")), '"', "")
    reference_type = F.when(F.col("role") == "parent", "parent_of").when(F.col("relation_type").isin(*RELATIONS), F.col("relation_type")).when(F.col("target_configuration").isNotNull(), "configuration_reference").when(F.col("target_type").isNull(), "uses")
    for name, types in TARGET_TYPES.items():
        reference_type = reference_type.when(kind.isin(*types), name)
    common = lambda status: [F.when(status, "dynamic").otherwise("unresolved").alias("resolution_status")]
    none = F.lit(None).cast("string")
    first = declared.select(
        "document_id", "ordinal", "source_id", "column", F.col("raw").alias("raw_text"), T.symbol_name(F.when(F.col("target_configuration").isNull(), target).otherwise(F.concat_ws(".", "target_configuration", name_part(target)))).alias("normalized_target"),
        reference_type.otherwise(kind).alias("reference_type"), F.when(F.col("role") == "parent", "configuration").otherwise(F.coalesce("target_technology", F.lit("configuration"))).alias("technology"),
        F.when(dynamic, "low").otherwise("high").alias("confidence"), *common(dynamic), none.alias("token_kind"), F.lit(False).alias("external"),
    )

    scanned = values.join(_of_role(declarations, "formula", "rule").groupBy("configuration", "column").agg(F.max((F.col("role") == "formula").cast("int")).alias("_f")), ["configuration", "column"])
    tokens = expression_tokens(scanned.select("document_id", "ordinal", "source_id", "configuration", "column", "raw", "expression").withColumn("_e", F.col("expression")), patterns)
    tokens = tokens.withColumn("_part", name_part(F.col("token")))
    local = values.join(_of_role(declarations, "variable", "parameter").select("configuration", "column", "role"), ["configuration", "column"])
    local = local.groupBy("document_id", "ordinal", F.lower(name_part(F.col("expression"))).alias("_key")).agg(F.min("role").alias("_low"), F.max("role").alias("_high"))
    met = tokens.withColumn("_key", F.lower("_part")).join(local, ["document_id", "ordinal", "_key"], "left")
    own = F.coalesce("kind", F.when(F.col("_low") == F.col("_high"), F.col("_low")), F.lit("unknown"))
    met = met.withColumn("_own", own).withColumn("_dynamic", _dynamic_expression(F.col("_e")))
    # tokens of one kind and name in a column are one, the least text of them
    once = met.groupBy("document_id", "ordinal", "source_id", "configuration", "column", F.coalesce("kind", F.lit("unknown")).alias("_hint"), "_key").agg(F.min(F.struct("token", "_part", "_own", "_dynamic")).alias("_t")).select("*", "_t.*")
    second = once.select(
        "document_id", "ordinal", "source_id", "column", F.col("token").alias("raw_text"), T.symbol_name(F.concat_ws(".", "configuration", "_part")).alias("normalized_target"), F.lit("configuration_token").alias("reference_type"), F.lit("configuration").alias("technology"),
        F.when(F.col("_dynamic"), "low").when(F.col("_own") != "unknown", "high").otherwise("medium").alias("confidence"), *common(F.col("_dynamic")), F.col("_own").alias("token_kind"), F.lit(False).alias("external"),
    )
    calls = F.regexp_extract_all("expression", F.lit(r"(?<![\w$#])([A-Za-z_][\w$#]*)\s*[(]"), F.lit(1))
    called = scanned.filter("_f = 1").select("document_id", "ordinal", "source_id", "column", "expression", F.explode(calls).alias("name")).filter("lower(name) != 'case'")
    called = called.groupBy("document_id", "ordinal", "source_id", "column", T.symbol_name(F.col("name")).alias("normalized_target")).agg(F.min("name").alias("raw_text"), F.first("expression").alias("expression"))
    dynamic = _dynamic_expression(F.col("expression"))
    third = called.select(
        "document_id", "ordinal", "source_id", "column", "raw_text", "normalized_target", F.lit("function_candidate").alias("reference_type"), F.lit("unknown").alias("technology"), F.when(dynamic, "low").otherwise("medium").alias("confidence"), *common(dynamic),
        F.lit("function_candidate").alias("token_kind"), F.lower("raw_text").isin(*EXTERNAL).alias("external"),
    )
    every = first.unionByName(second).unionByName(third)
    one = ["document_id", "ordinal", "raw_text", "normalized_target", "reference_type"]
    rest = [c for c in every.columns if c not in one]
    return every.groupBy(*one).agg(F.min(F.struct(*rest)).alias("_r")).select(*one, "_r.*")

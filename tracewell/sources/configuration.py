"""Declarative configuration in DML scripts: every statement becomes a record of a declared table or says why it is none."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import text as T
from tracewell.sources.dml import statements, value_type

#: Reasons that are errors; all others are warnings.
ERRORS = (
    "column_value_mismatch", "malformed_insert", "malformed_update", "max_literal_chars", "max_statements_per_file", "missing_default_column_order", "missing_identity", "missing_identity_where", "missing_set",
)
#: Words that a statement of a kind must not hold outside of strings.
FORBIDDEN = {"insert": {"RETURNING", "SELECT"}, "update": {"RETURNING", "FROM", "OR", "IN", "LIKE"}}
KINDS = {"INSERT": "insert", "UPDATE": "update", "BEGIN": "plsql_block", "DECLARE": "plsql_block", "COMMIT": "commit"}

_LEXEME = re.compile(r"(?P<blank>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:[^']|'')*(?:'|\Z))|(?P<name>[A-Za-z_][\w$#]*|\"[^\"]*\")|(?P<other>\d+(?:\.\d+)?|.)", re.DOTALL)


class Lexeme(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    depth: int


def lexemes(text: str) -> list[Lexeme]:
    """What is neither blank nor comment, with how many parentheses are open around it; a parenthesis counts as outside of itself."""
    out, depth = [], 0
    for m in _LEXEME.finditer(text):
        if m.lastgroup != "blank":
            depth -= m[0] == ")"
            out.append(Lexeme(m.lastgroup, m[0], m.start(), m.end(), depth))
            depth += m[0] == "("
    return out


def _parts(text: str, found: list[Lexeme], separator: str, depth: int) -> list[list[Lexeme]]:
    """Lexemes between separators at a depth; none of none."""
    out: list[list[Lexeme]] = [[]]
    for x in found:
        if x.depth == depth and x.text.upper() == separator:
            out.append([])
        else:
            out[-1].append(x)
    return out if found else []


def _raw(text: str, found: list[Lexeme]) -> str:
    return text[found[0].start : found[-1].end] if found else ""


def _table(found: list[Lexeme]) -> tuple[str, int]:
    """A name, qualified by any number of others, and how many lexemes it takes; none if there is none."""
    n = 1 if found and found[0].kind == "name" else 0
    while n and len(found) > n + 1 and found[n].text == "." and found[n + 1].kind == "name":
        n += 2
    return "".join(x.text for x in found[:n]), n


def _assignments(text: str, found: list[Lexeme], separator: str) -> list[tuple[str, str]] | None:
    out = []
    for part in _parts(text, found, separator, 0):
        name, n = _table(part)
        if not n or len(part) < n + 2 or part[n].text != "=":
            return None
        out.append((name, _raw(text, part[n + 1 :])))
    return out or None


def read_statement(text: str) -> dict:
    """A statement's parts: kind, shape (why it can't be read, or null), table, has_columns, columns, values, keys (how many values come first and are keys), set_ok, where_ok."""
    found = lexemes(text)
    upper = [x.text.upper() if x.kind == "name" else x.text for x in found]
    kind = KINDS.get(upper[0] if upper else "", "unknown")
    out = {"kind": kind, "shape": None, "table": None, "has_columns": True, "columns": [], "values": [], "keys": 0, "set_ok": True, "where_ok": True}
    if kind not in FORBIDDEN:
        return out | {"shape": "unsupported_statement"}
    words = {u for u, x in zip(upper, found, strict=True) if x.kind == "name"}
    inner_query = any(a == "(" and b == "SELECT" for a, b in zip(upper, upper[1:], strict=False))
    if words & FORBIDDEN[kind] or inner_query or upper[1:2] == ["ALL"]:
        return out | {"shape": f"unsupported_{kind}"}
    bad = out | {"shape": f"malformed_{kind}"}
    at = 2 if kind == "insert" else 1
    table, n = _table(found[at:])
    at += n
    if not n or (kind == "insert" and upper[1] != "INTO"):
        return bad
    out["table"] = table
    if kind == "insert":
        groups = []  # the columns, if there are any, and the values
        for opener in ("", "VALUES"):
            at += bool(opener) and upper[at : at + 1] == ["VALUES"]
            if upper[at : at + 1] == ["("]:
                close = next((i for i in range(at + 1, len(found)) if found[i].text == ")" and found[i].depth == found[at].depth), None)
                if close is None:
                    return bad
                groups.append((upper[at - 1] == "VALUES", _parts(text, found[at + 1 : close], ",", 1)))
                at = close + 1
        if at != len(found) or not groups or not groups[-1][0] or (len(groups) == 2 and groups[0][0]):
            return bad
        columns = [_raw(text, p) for p in groups[0][1]] if len(groups) == 2 else []
        return out | {"has_columns": len(groups) == 2, "columns": columns, "values": [_raw(text, p) for p in groups[-1][1]]}
    where = next((i for i in range(at, len(found)) if found[i].depth == 0 and upper[i] == "WHERE"), None)
    if upper[at : at + 1] != ["SET"] or where is None:
        return bad
    sets, keys = _assignments(text, found[at + 1 : where], ","), _assignments(text, found[where + 1 :], "AND")
    pairs = [*(keys or []), *(sets or [])]
    return out | {"columns": [c for c, _ in pairs], "values": [v for _, v in pairs], "keys": len(keys or []), "set_ok": sets is not None, "where_ok": keys is not None}


_READ = "kind string, shape string, table string, has_columns boolean, columns array<string>, values array<string>, keys int, set_ok boolean, where_ok boolean"


def identifier(name: Column) -> Column:
    return F.lower(F.btrim(F.btrim(name), F.lit('"')))


def _bare(table: Column) -> Column:
    """The last part of a table's name."""
    return identifier(F.element_at(F.split(table, r"\."), -1))


def declared_columns(declarations: DataFrame, role: str) -> DataFrame:
    """(configuration, columns) of one role, in order."""
    rows = declarations.filter(F.col("role") == role)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("position", identifier(F.col("column_name")).alias("c")))), lambda x: x["c"])
    return rows.groupBy("configuration").agg(listed.alias(f"_{role}"))


def read_configurations(scripts: DataFrame, declarations: DataFrame, most_statements: int | None = None, most_chars: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Records and diagnostics of DML scripts: each statement outside of a block is one of them.

    scripts: document_id, text. declarations: configuration, role, column_name, position (and what further roles need): the role ``table`` names a configuration's tables, ``identity`` the columns that tell its records apart, ``default`` the order
    of an INSERT without columns. Declarations are as many as a team writes by hand, and are joined, not collected.

    Records: document_id, ordinal, start_line, end_line, configuration, table_name, operation, partial (an UPDATE's), record_id, values (array of column, raw, value_type, position, is_identity). Diagnostics: document_id, ordinal, start_line,
    end_line, statement_type, reason, severity. A block from BEGIN or DECLARE is one diagnostic; what is in it, up to END, is none. Scripts are read whole, unless ``most_statements`` is given: then a script of over that many is one diagnostic. A value over ``most_chars`` is one.
    The first declared configuration of a table holds, by name. Null texts have no statements.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.concat([frame.drop(columns="text"), pd.DataFrame([read_statement(t) for t in frame["text"]], columns=[c.split()[0] for c in _READ.split(", ")], index=frame.index)], axis=1)

    found = statements(scripts.select("document_id", "text")).withColumn("ordinal", F.col("ordinal") + 1)
    document = Window.partitionBy("document_id")
    kind = dict(scripts.dtypes)["document_id"]
    over = None
    if most_statements is not None:
        found = found.withColumn("_n", F.count(F.lit(1)).over(document))
        over = found.filter((F.col("_n") > most_statements) & (F.col("ordinal") == 1))
        over = over.select("document_id", F.lit(most_statements + 1).alias("ordinal"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("limit").alias("statement_type"), F.lit("max_statements_per_file").alias("reason"))
        found = found.filter(F.col("_n") <= most_statements)
    kept = found.select("document_id", "ordinal", "start_line", "end_line", "text")
    ends = F.regexp_replace(kept["text"], r"(?s)--[^\n]*|/\*.*?\*/", " ").rlike(r"(?i)^\s*END(\s+[A-Z_][\w$#]*)?\s*$")
    kept = kept.withColumn("_ends", ends)
    read = kept.mapInPandas(parse, f"document_id {kind}, ordinal int, start_line int, end_line int, _ends boolean, {_READ}")
    before = document.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda when: F.coalesce(F.max(F.when(when, F.col("ordinal"))).over(before), F.lit(0))
    read = read.withColumn("_inside", last(F.col("kind") == "plsql_block") > last(F.col("_ends"))).filter("not _inside")

    tables = declarations.filter("role = 'table'").groupBy(_bare(F.col("column_name")).alias("_table")).agg(F.min("configuration").alias("configuration"))
    rows = read.withColumn("_table", _bare(F.col("table"))).join(tables, "_table", "left")
    for role in ("identity", "default"):
        rows = rows.join(declared_columns(declarations, role), "configuration", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"_identity": F.coalesce("_identity", none), "_default": F.coalesce("_default", none)})
    rows = rows.withColumn("columns", F.when(F.col("has_columns"), F.transform("columns", identifier)).otherwise(F.col("_default")))
    keyed = F.slice("columns", F.lit(1), F.col("keys"))
    update = F.col("kind") == "update"
    reason = (
        F.when(F.col("shape").isNotNull(), F.col("shape"))
        .when(F.col("configuration").isNull(), "undeclared_table")
        .when(~F.col("has_columns") & (F.size("_default") == 0), "missing_default_column_order")
        .when(F.size("columns") != F.size("values"), "column_value_mismatch")
        .when(~F.col("set_ok"), "missing_set")
        .when(~F.col("where_ok"), "unsupported_where")
        .when(update & (F.size(F.array_except("_identity", keyed)) > 0), "missing_identity_where")
        .when(F.exists("values", lambda v: F.char_length(v) > most_chars), "max_literal_chars")
        .when(F.size(F.array_except("_identity", "columns")) > 0, "missing_identity")
    )
    rows = rows.withColumn("reason", reason)
    diagnostics = rows.filter("reason is not null").select("document_id", "ordinal", "start_line", "end_line", F.col("kind").alias("statement_type"), "reason")
    diagnostics = diagnostics if over is None else diagnostics.unionByName(over)
    diagnostics = diagnostics.withColumn("severity", F.when(F.col("reason").isin(*ERRORS), "error").otherwise("warning"))
    values = F.transform(
        F.arrays_zip("columns", "values"),
        lambda x, i: F.struct(x["columns"].alias("column"), x["values"].alias("raw"), value_type(x["values"]).alias("value_type"), (i + 1).alias("position"), F.array_contains("_identity", x["columns"]).alias("is_identity")),
    )
    records = rows.filter("reason is null").withColumn("values", values)
    told = F.array_join(F.array_sort(F.transform(F.filter("values", lambda v: v["is_identity"]), lambda v: F.concat(v["column"], F.lit("="), v["raw"]))), "|")
    record_id = T.deterministic_id(F.col("configuration"), F.col("_table"), told)
    records = records.select("document_id", "ordinal", "start_line", "end_line", "configuration", F.lower("table").alias("table_name"), F.col("kind").alias("operation"), update.alias("partial"), record_id.alias("record_id"), "values")
    return records, diagnostics


def configuration_scripts(files: DataFrame, declarations: DataFrame, pattern: str = "%") -> DataFrame:
    """Files that may hold configuration: (document_id, configurations), those whose path is like ``pattern`` and ends in .sql and whose DML names a declared table.

    files: document_id, relative_path, text. What follows INSERT INTO or UPDATE is looked up by its last part.
    """
    named = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r'(?i)\b(?:insert\s+into|update)\s+((?:[\w$#]+|"[^"]*")(?:\s*\.\s*(?:[\w$#]+|"[^"]*"))*)'), F.lit(1))
    chosen = files.filter(F.lower("relative_path").endswith(".sql") & F.col("relative_path").like(pattern))
    each = chosen.select("document_id", F.explode(F.array_distinct(F.transform(named, _bare))).alias("_table"))
    tables = declarations.filter("role = 'table'").select("configuration", _bare(F.col("column_name")).alias("_table")).distinct()
    return each.join(tables, "_table").groupBy("document_id").agg(F.array_sort(F.collect_set("configuration")).alias("configurations"))


def configuration_metrics(scripts: DataFrame, records: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Of each script with records or diagnostics: records, partial ones, warnings, errors. Scripts with neither have no row."""
    a = records.select("document_id", F.lit(1).alias("r"), F.col("partial").cast("int").alias("p"), F.lit(0).alias("w"), F.lit(0).alias("e"))
    b = diagnostics.select("document_id", F.lit(0).alias("r"), F.lit(0).alias("p"), (F.col("severity") == "warning").cast("int").alias("w"), (F.col("severity") == "error").cast("int").alias("e"))
    counted = a.unionByName(b).groupBy("document_id").agg(*[F.sum(x).alias(name) for x, name in (("r", "records"), ("p", "partial"), ("w", "warnings"), ("e", "errors"))])
    return scripts.select("document_id").distinct().join(counted, "document_id")

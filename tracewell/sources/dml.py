"""Statements and records of DML scripts that hold declarative configuration."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What ends or hides parts of a statement: strings, quoted names, comments, and the separator.
_PIECE = re.compile(r"'(?:[^']|'')*(?:'|\Z)|\"[^\"]*(?:\"|\Z)|--[^\n]*|/\*.*?(?:\*/|\Z)|;", re.DOTALL)
_CONSOLE = re.compile(r"(?im)^[ \t]*(?:PROMPT|SET[ \t]+\w+[ \t]+(?:ON|OFF|\d+))\b[^\n]*$")
_STATEMENT = "array<struct<text:string,start_line:int,end_line:int,terminated:boolean>>"


def split_statements(script: str) -> list[tuple[str, int, int, bool]]:
    """(text, first line, last line, terminated) of each statement; semicolons in strings, names and comments don't count, and a
    rest inside an open string or comment is dropped."""
    script = _CONSOLE.sub(lambda m: " " * len(m[0]), script)
    out, start, opened = [], 0, False
    line, counted = 1, 0  # the line of the place up to which line ends are counted, so that a script is counted once

    def line_at(place: int) -> int:
        nonlocal line, counted
        line, counted = line + script.count("\n", counted, place), place
        return line

    def add(end: int, terminated: bool) -> None:
        text = script[start:end]
        if text.strip():
            first = line_at(start + len(text) - len(text.lstrip()))
            out.append((text.strip(), first, line_at(start + len(text.rstrip())), terminated))

    for m in _PIECE.finditer(script):
        piece = m[0]
        if piece == ";":
            add(m.start(), True)
            start = m.end()
        elif m.end() == len(script):
            opened = (piece[0] == "'" and piece.count("'") % 2 == 1) or (piece.startswith("/*") and not piece.endswith("*/"))
    if not opened:
        add(len(script), False)
    return out


def statements(docs: DataFrame) -> DataFrame:
    """Rows (document_id, ordinal, text, start_line, end_line, terminated). In: document_id, text (a script)."""

    @F.pandas_udf(_STATEMENT)
    def split(scripts: pd.Series) -> pd.Series:
        keys = ("text", "start_line", "end_line", "terminated")
        return scripts.map(lambda s: [dict(zip(keys, x, strict=True)) for x in split_statements(s or "")])

    found = docs.select("document_id", F.posexplode(split("text")).alias("ordinal", "_s"))
    return found.select("document_id", "ordinal", "_s.*")


_NAME = r'[\w$#."]+'
INSERT = rf"(?is)^\s*INSERT\s+INTO\s+({_NAME})\s*\((.*?)\)\s*VALUES\s*\((.*)\)\s*$"
UPDATE = rf"(?is)^\s*UPDATE\s+({_NAME})\s+SET\s+(.*?)\s+WHERE\s+(.*)$"


def split_top(text: str | None, word: str = ",") -> list[str]:
    """Parts between commas (or the word AND) that are in no string and no parentheses."""
    separator = re.compile(rf"'(?:[^']|'')*'|[()]|{word if word == ',' else rf'(?i:\b{word}\b)'}")
    out, depth, start = [], 0, 0
    for m in separator.finditer(text or ""):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= 1
        elif m[0][0] != "'" and not depth:
            out.append(text[start : m.start()].strip())
            start = m.end()
    return [*out, (text or "")[start:].strip()]


def value_type(value):
    """The kind of a DML value, as a Column."""
    v = F.btrim(value)
    return (
        F.when(v.rlike(r"(?s)^'.*'$"), "string")
        .when(v.rlike(r"^[+-]?\d+(\.\d+)?$"), "number")
        .when(v.rlike(r"(?i)^null$"), "null")
        .when(v.rlike(r"(?i)^(date|timestamp)\s*'"), "date_literal")
        .when(v.rlike(r"^[:&]"), "placeholder")
        .when(v.rlike(r"(?s)^[A-Za-z_][\w.$#]*\s*\(.*\)$"), "function_expression")
        .otherwise("expression")
    )


def records(found: DataFrame) -> DataFrame:
    """The columns of INSERT ... VALUES and UPDATE ... SET ... WHERE k = v statements: document_id, ordinal, operation, table_name,
    column_name, value, value_type, is_key. Other statements, and inserts whose columns and values differ in number, have no rows.

    In: the rows of statements().
    """

    def split(word: str):
        @F.pandas_udf("array<string>")
        def parts(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: split_top(t, word))

        return parts

    comma, both = split(","), split("and")
    part = lambda p, i: F.regexp_extract("text", p, i)
    inserts = found.filter(F.col("text").rlike(INSERT)).select("document_id", "ordinal", part(INSERT, 1).alias("table_name"), comma(part(INSERT, 2)).alias("_c"), comma(part(INSERT, 3)).alias("_v"))
    inserts = inserts.filter(F.size("_c") == F.size("_v")).select("document_id", "ordinal", "table_name", F.explode(F.arrays_zip("_c", "_v")).alias("_z"))
    inserts = inserts.select("document_id", "ordinal", F.lit("insert").alias("operation"), "table_name", F.col("_z._c").alias("column_name"), F.col("_z._v").alias("value"), F.lit(False).alias("is_key"))
    updates = found.filter(F.col("text").rlike(UPDATE)).select("document_id", "ordinal", part(UPDATE, 1).alias("table_name"), comma(part(UPDATE, 2)).alias("_s"), both(part(UPDATE, 3)).alias("_k"))
    pairs = F.concat(*[F.transform(c, _assignment(key)) for c, key in (("_s", False), ("_k", True))])
    updates = updates.select("document_id", "ordinal", F.lit("update").alias("operation"), "table_name", F.explode(pairs).alias("_p"))
    updates = updates.select("document_id", "ordinal", "operation", "table_name", "_p.*").filter("column_name != ''")
    out = inserts.unionByName(updates)
    return out.withColumns({"table_name": F.lower("table_name"), "column_name": F.lower("column_name"), "value_type": value_type(F.col("value"))})


def _assignment(key: bool):
    pattern = rf"(?s)^\s*({_NAME})\s*=\s*(.*)$"
    return lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("column_name"), F.regexp_extract(x, pattern, 2).alias("value"), F.lit(key).alias("is_key"))

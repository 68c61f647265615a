"""Compare a Spark result with DuckDB's, as sets of rows with repetition."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(columns, tuples):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(t[i]) for i in order) for t in tuples)


def same(spark, query, sql: str) -> None:
    found = query(spark, SF_DIR)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, expected.fetchall())

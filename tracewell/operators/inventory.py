"""Counts over the catalog: symbols, relations, references, runs, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inventory_items(symbols: DataFrame, relations: DataFrame, references: DataFrame) -> DataFrame:
    """Each symbol with its distinct outgoing and incoming relations and references. Each side is counted before it is
    joined, so a symbol of many relations is never multiplied out."""
    by = lambda df, key, name, count: df.groupBy(F.col(key).alias("symbol_id")).agg(F.countDistinct(count).alias(name))
    out = symbols
    for df, key, name, count in (
        (relations, "source_symbol_id", "outgoing", "relation_id"),
        (relations, "target_symbol_id", "incoming", "relation_id"),
        (references, "source_symbol_id", "referenced", "reference_id"),
    ):
        out = out.join(by(df.filter(F.col(key).isNotNull()), key, name, count), "symbol_id", "left")
    return out.fillna(0, ["outgoing", "incoming", "referenced"])


def inventory_summary(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """How many symbols there are, how many of them are a source or a target, and their relations."""
    ends = relations.select(F.col("source_symbol_id").alias("symbol_id"), "relation_id", F.lit("out").alias("side")).unionByName(
        relations.select(F.col("target_symbol_id").alias("symbol_id"), "relation_id", F.lit("in").alias("side"))
    )
    joined = symbols.select("symbol_id").join(ends, "symbol_id", "left")
    one = lambda side: F.countDistinct(F.when(F.col("side") == side, F.col("symbol_id")))
    return joined.agg(F.countDistinct("symbol_id").alias("symbols"), one("out").alias("sources"), one("in").alias("targets"), F.countDistinct("relation_id").alias("relations"))


def status_counts(rows: DataFrame, key: str, statuses: list[str], status: str = "status") -> DataFrame:
    """Rows of each key in all and by status, as columns."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in statuses])


def run_statistics(runs: DataFrame, statuses: list[str]) -> DataFrame:
    """One row: runs by status, mean of value, and the last run's id and status. In: run_id, status, value."""
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses],
        F.avg("value").alias("mean_value"),
        F.max("run_id").alias("last_run"),
        F.max_by("status", "run_id").alias("last_status"),
    )


def dominant_value(rows: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the alphabetically first of equals, with its count."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1)


def manifest_summaries(manifests: DataFrame, chunks: DataFrame, statuses: list[str]) -> DataFrame:
    """Each manifest with the counts of its chunks by status, zero if it has none. Both: manifest_id; chunks: status."""
    counted = status_counts(chunks, "manifest_id", statuses)
    return manifests.join(counted, "manifest_id", "left").fillna(0, ["total", *statuses])


def without_partner(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def with_partner(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_semi")


def latest_with(runs: DataFrame, errors: DataFrame, key: str, also: str) -> DataFrame:
    """The latest run that has errors, or is marked by the boolean column ``also``."""
    failing = runs.join(errors.select(key).distinct().withColumn("_e", F.lit(True)), key, "left")
    return failing.filter(F.coalesce("_e", F.lit(False)) | F.col(also)).orderBy(F.desc(key)).limit(1).drop("_e")


def lower_percentiles(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """For each share p the value at place floor((n - 1) p) of the ascending values, without interpolation.

    Values are counted first, so places come from a running sum over the distinct values, and not over all rows.
    """
    from pyspark.sql.window import Window

    counts = rows.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy("value")
    placed = counts.withColumn("_last", F.sum("_n").over(order)).withColumn("_first", F.col("_last") - F.col("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    wanted = total.select(F.explode(F.array(*[F.struct(F.lit(p).alias("share"), F.floor((F.col("_all") - 1) * p).alias("_at")) for p in shares])).alias("_w")).select("_w.*")
    return placed.join(F.broadcast(wanted), (F.col("_first") <= F.col("_at")) & (F.col("_at") < F.col("_last"))).select("share", "value")

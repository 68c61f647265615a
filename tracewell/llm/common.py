"""Helpers that the operators share: materialising, gapless numbering, word and id conventions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the operators' word and line rules: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id: smaller than every id that tables hold.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a new one (tests); a cluster must name it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        where = context._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: what follows reads the files, and lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewell-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """df, which should be written, with a broadcast hint if it has ``most_rows`` rows at most; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def id_or_lowest(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_or_null(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def gapless(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Number the rows of each key 0, 1, 2 ... in a new column, without bringing a key together in one task.

    Rows are written with the task that wrote them; a window numbers each key's rows of a task, and the number of its
    rows in earlier tasks is added. Tasks grow in number with the rows, so neither a key with most rows nor repeated rows fill one. The
    table of offsets has a row per key and task, so callers' keys are few (shards, length classes).
    """
    held = written(df.withColumns({"_b": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "numbered")
    counts = held.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")), "offsets")
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_i"))
    return held.withColumn("_r", inside).join(offsets, [*keys, "_b"]).withColumn(out, F.col("_o") + F.col("_r") - 1).drop("_b", "_i", "_r", "_o")


def positions(df: DataFrame, key: str, order: list[str], out: str, name: str, rows_a_range: int = 500_000) -> DataFrame:
    """Number the rows of each key 0, 1, 2 ... by ``order``, which should end in a unique column, in a new column.

    Rows are dealt by ranges of key and order, numbered within a range, and what a key has in earlier ranges is added: a key that holds any
    share of all rows takes as many tasks as its rows need.
    """
    parts = max(df.count() // rows_a_range + 1, df.sparkSession.sparkContext.defaultParallelism)
    held = written(df.repartitionByRange(parts, key, *order).withColumn("_b", F.spark_partition_id()), f"{name}-ranges")
    counts = held.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")), f"{name}-offsets")
    inside = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order))
    return held.withColumn("_r", inside).join(offsets, [key, "_b"]).withColumn(out, F.col("_o") + F.col("_r") - 1).drop("_b", "_r", "_o")

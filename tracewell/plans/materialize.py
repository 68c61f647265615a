"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local master gets a new folder (tests); a cluster must name it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        where = context._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back, so that what is built on it starts from files and not from its plan."""
    path = f"{shared_dir(df.sparkSession)}/tracewell-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Sharding by jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import gapless, id_or_lowest, id_or_null

MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The jump consistent hash of unsigned 64-bit keys; all keys of a batch jump together until none moves."""
    key, at, to = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = to[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * MULTIPLIER + np.uint64(1)
        steps = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        to[live] = ((at[live] + 1).astype(np.float64) * (float(1 << 31) / steps)).astype(np.int64)
        live = live[to[live] < shards]
    return at


def jump_shard(shards: int):
    """A pandas UDF: a 64-bit key to its shard among 0 .. shards - 1."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard


def shard_documents(docs: DataFrame, shards: int = 24, slots: bool = True) -> DataFrame:
    """Put each document into a shard that its doc_id and the number of shards alone decide (the law ``key``).

    In: doc_id, text (others are ignored). Out: a row per input row with doc_id, size (UTF-8 bytes of the text, none
    for null, plus 8), text_crc32, law, shard, grown_shard (its shard if there were one more: the same or the new one) and,
    with ``slots``, slot: the row's place in its shard, gapless from 0, in no particular order.

    A null doc_id is a key like any other. Repeated rows share a shard and get slots of their own. Null and empty texts
    have size 8 and checksum 0. An empty table gives an empty table. Texts are not shuffled: only ids, sizes and
    checksums are, for the slots; a shard's slots come from the tasks that wrote its rows, so no task holds a shard.
    A very long text is measured where it is read; input columns with the result's names are ignored.
    """
    mixed = F.xxhash64(F.col("_d"))
    base = docs.select(
        id_or_lowest("doc_id").alias("_d"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = base.select(
        "*",
        F.lit("key").alias("law"),
        jump_shard(shards)(mixed).alias("shard"),
        jump_shard(shards + 1)(mixed).alias("grown_shard"),
    )
    if slots:
        placed = gapless(placed, ["shard"], "slot")
    return placed.withColumn("doc_id", id_or_null("_d")).drop("_d")

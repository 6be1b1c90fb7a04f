"""Shards by jump consistent hashing: no ring table, and growing moves only what must move."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import documents, saved, whole

#: Multiplier of the published 64-bit generator.
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key by the jump consistent hash, for all keys at once.

    A key that is in shard s of n shards is in s or in the new shard n of n + 1.
    """
    state = keys.astype(np.int64).view(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * STEP + np.uint64(1)
        spread = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((at[live] + 1) * spread).astype(np.int64)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of an integer key column; a null key counts as 0."""
    @F.pandas_udf(T.IntegerType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(jump(batch.to_numpy(), shards))

    return run(F.coalesce(key.cast("long"), F.lit(0)))


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
           overhead: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, grown_shard, slot.

    ``slot`` numbers each shard's rows from 0 without gaps. Rows are numbered inside
    (block, shard), where a block is one input split, and blocks are put one after
    another by their counts; no task sees a whole shard, and repeated ids spread
    over their blocks. Null text counts as empty, a null id as key 0. Empty tables
    give no rows. Only narrow rows are kept, no texts.
    """
    text, key = whole(F.col(text_col)), F.col(id_col).cast("long")
    rows = saved(docs.select(
        key.alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"), F.spark_partition_id().alias("block"),
        shard_of(key, shards).alias("shard"), shard_of(key, shards + 1).alias("grown_shard")), "shards")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "block"]).withColumn(
        "slot", (F.col("start") + F.col("at")).cast("long")).drop("start", "at", "block")


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id") -> None:
    """Write ``docs`` laid out by shard, each input split straight to its shards, without a shuffle."""
    docs.withColumn("shard", shard_of(F.col(id_col), shards)).write.partitionBy("shard").parquet(path)


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 shards, and where each would be with one more."""
    return assign(documents(spark, sf_dir), 40).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

"""A table of keys seen so far, on storage instead of in a stream's state."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


class SeenTable:
    """Keys with the batch that brought them first, as parquet bucketed and sorted by a 64-bit hash of the key.

    A batch finds its new keys by a sort-merge anti-join: only the batch is dealt out,
    the table is read bucket by bucket without an exchange, and equal hashes are told
    apart by the keys themselves, nulls equal to each other. A batch that is repeated
    after a failure does not see its own keys, so it gives the same rows again.
    """

    def __init__(self, spark: SparkSession, location: str, keys: T.StructType, buckets: int = 64) -> None:
        self.spark, self.location, self.keys, self.buckets = spark, location.rstrip("/"), keys, buckets
        self.table = "seen_keys_" + hashlib.md5(self.location.encode()).hexdigest()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (_hash BIGINT, {columns}, _batch BIGINT) USING parquet "
            f"CLUSTERED BY (_hash) SORTED BY (_hash) INTO {buckets} BUCKETS LOCATION '{self.location}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def hash(self) -> Column:
        return F.xxhash64(*[x for k in self.keys.names for x in (F.col(k).isNull(), F.col(k))])

    def first_of(self, batch: DataFrame, order: Sequence[str], batch_id: int) -> DataFrame:
        """The first row of each key of the batch, by ``order``, that no earlier batch had."""
        names = self.keys.names
        window = Window.partitionBy("_hash", *names).orderBy(*order)
        first = batch.withColumn("_hash", self.hash()).withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")
        known = self.rows().filter(F.col("_batch") < batch_id).select(
            F.col("_hash").alias("_known"), *[F.col(n).alias(f"_known_{n}") for n in names]).hint("merge")
        same = first["_hash"] == known["_known"]
        for n in names:
            a, b = first[n], known[f"_known_{n}"]
            # Not a null-safe equality: that would join by the key and deal the table out by it.
            same &= F.coalesce(a == b, a.isNull() & b.isNull())
        return first.join(known, same, "left_anti")

    def add(self, new: DataFrame, batch_id: int) -> None:
        """Append the keys of rows that have ``_hash``; as many partitions as buckets, so each task writes one file."""
        # A repeated batch has its keys in the table; they stand there once.
        own = self.rows().filter(F.col("_batch") == batch_id).select("_hash").distinct()
        new.select("_hash", *self.keys.names, F.lit(batch_id).cast("long").alias("_batch")).join(
            own, "_hash", "left_anti").repartition(self.buckets, "_hash").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def size(self) -> DataFrame:
        """batch, keys: how many keys each batch added."""
        return self.rows().groupBy(F.col("_batch").alias("batch")).agg(F.count(F.lit(1)).alias("keys"))

    def compact(self, location: str) -> SeenTable:
        """The same keys in a new folder, with one sorted file per bucket instead of one per bucket and batch."""
        out = SeenTable(self.spark, location, self.keys, self.buckets)
        self.rows().repartition(self.buckets, "_hash").write.insertInto(out.table)
        self.spark.catalog.refreshTable(out.table)
        return out


def dedupe_stored(pages: DataFrame, seen: SeenTable, path: str, checkpoint: str, time: str = "crawled_at",
                  tie: Sequence[str] = ()) -> StreamingQuery:
    """First arrival of each key, exact over the whole life of the stream; no state is held.

    Rows go to a folder per batch under ``path``, which a repeated batch replaces;
    within a batch the first by (time, tie) counts, nulls first.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        first = seen.first_of(batch, [time, *tie], batch_id)
        folder = f"{path}/batch={batch_id}"
        first.write.mode("overwrite").parquet(folder)
        # What was written is what is added, also where rows alike in time came in another order.
        seen.add(seen.spark.read.schema(first.schema).parquet(folder), batch_id)

    return (
        pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


class FirstArrivals:
    """A stream of which the first row of each key is put out; the keys stand in a :class:`SeenTable`.

    Nothing is held in a stream's state, which every micro-batch would have to open,
    to search key by key and to save again: a batch is joined with the table instead.
    """

    def __init__(self, stream: DataFrame, keys: Sequence[str], time: str) -> None:
        self.stream, self.keys, self.time = stream, list(keys), time
        self.sparkSession = stream.sparkSession

    def start(self, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
        """Run over all data present; further runs with the same folders and buckets go on from there."""
        spark = self.sparkSession
        seen = SeenTable(spark, f"{path}/seen", T.StructType([self.stream.schema[k] for k in self.keys]), buckets)
        spark.createDataFrame([], self.stream.schema).write.mode("overwrite").parquet(f"{path}/out/none")
        return dedupe_stored(self.stream, seen, f"{path}/out", checkpoint, self.time)

    def written(self, path: str) -> DataFrame:
        """All rows that were put out so far."""
        return self.sparkSession.read.schema(self.stream.schema).parquet(f"{path}/out/*")

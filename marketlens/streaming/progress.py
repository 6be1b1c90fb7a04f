"""Running counts per scan, kept in a table of a row per scan instead of in a stream's state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


class ScanProgress:
    """A stream of pages folded to one row per scan, micro-batch by micro-batch.

    A batch is folded first, then with the scans that stood before, a row each. A
    state store for each shuffle partition would be opened and saved in every batch,
    however few scans it holds. The scans stand in two folders in turn: a batch reads
    the one of the batch before and replaces the other, so a repeated batch gives the
    same.
    """

    def __init__(self, pages: DataFrame, totals: DataFrame, time: str, tie: Sequence[str]) -> None:
        self.totals, self.sparkSession = totals, pages.sparkSession
        self.pages = pages.select("scan_id", "url", F.struct(time, *tie).alias("_at"))
        self.schema = T.StructType([
            self.pages.schema["scan_id"], T.StructField("pages_crawled", T.LongType()),
            T.StructField("current_url", self.pages.schema["url"].dataType), self.pages.schema["_at"],
            T.StructField("batch", T.IntegerType())])

    def _folded(self, batch: DataFrame, path: str, batch_id: int) -> DataFrame:
        """The scans after the batch, with the last batch that brought a page of theirs."""
        rows = batch.groupBy("scan_id").agg(
            F.count(F.lit(1)).alias("pages_crawled"), F.max_by("url", "_at").alias("current_url"),
            F.max("_at").alias("_at")).withColumn("batch", F.lit(batch_id))
        if batch_id == 0:
            return rows
        known = self.sparkSession.read.schema(self.schema).parquet(f"{path}/scans/{(batch_id - 1) % 2}")
        return rows.unionByName(known).groupBy("scan_id").agg(
            F.sum("pages_crawled").alias("pages_crawled"), F.max_by("current_url", "_at").alias("current_url"),
            F.max("_at").alias("_at"), F.max("batch").alias("batch"))

    def start(self, path: str, checkpoint: str, buckets: int | None = None) -> StreamingQuery:
        """Run over all data present; further runs with the same folders go on from there."""
        spark = self.sparkSession

        def write(batch: DataFrame, batch_id: int) -> None:
            scans = f"{path}/scans/{batch_id % 2}"
            self._folded(batch, path, batch_id).write.mode("overwrite").parquet(scans)
            touched = spark.read.schema(self.schema).parquet(scans).filter(F.col("batch") == batch_id).drop("_at")
            share = F.try_divide(F.col("pages_crawled") * 100, F.col("total"))
            touched.join(self.totals, "scan_id").withColumn("progress", F.least(F.lit(100), share.cast("int"))).select(
                *self._columns().names).write.mode("overwrite").parquet(f"{path}/out/{batch_id:012d}")

        spark.createDataFrame([], self._columns()).write.mode("overwrite").parquet(f"{path}/out/none")
        return (
            self.pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )

    def _columns(self) -> T.StructType:
        return T.StructType([
            *[self.schema[c] for c in ("scan_id", "pages_crawled", "current_url")],
            T.StructField("progress", T.IntegerType()), self.schema["batch"]])

    def written(self, path: str) -> DataFrame:
        """All rows that were put out so far, with the batch that put them out."""
        return self.sparkSession.read.schema(self._columns()).parquet(f"{path}/out/*")

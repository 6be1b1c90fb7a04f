"""Writers and retention rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.times import before
from marketlens.plans.skew import top_n_per_key


def append_snapshot(df: DataFrame, path: str, ts: str, fmt: str = "parquet") -> None:
    """Append rows to a table laid out by day.

    An append that is repeated writes its rows twice; where batches can be repeated,
    take :class:`SnapshotLog`. Rows of one day are spread over tasks by AQE after the rebalance, so a day
    holding most rows yields several files of even size, not one writer.
    """
    (
        df.withColumn("snapshot_date", F.to_date(ts))
        .hint("rebalance", "snapshot_date")
        .write.mode("append").partitionBy("snapshot_date").format(fmt).save(path)
    )


class SnapshotLog:
    """Snapshots appended batch by batch, each counted once however often it is written.

    Rows go to a folder of their batch, laid out by day; the batch counts from the
    moment its entry stands in the ledger, one small file that is put in place by a
    rename. A batch that broke off has no entry: nobody reads its rows, and the next
    try replaces them. A batch with an entry is left as it is. ``compact`` writes
    several batches as one whose entry takes their place.
    """

    def __init__(self, spark: SparkSession, path: str, ts: str) -> None:
        self.spark, self.path, self.ts = spark, path.rstrip("/"), ts
        # An empty ledger is a ledger.
        spark.createDataFrame([], "batch string, replaces array<string>").write.mode("append").parquet(f"{self.path}/ledger/none")

    def ledger(self) -> DataFrame:
        """batch, replaces: the entries so far."""
        return self.spark.read.schema("batch string, replaces array<string>").parquet(f"{self.path}/ledger/*")

    def batches(self) -> DataFrame:
        """batch: those that count."""
        gone = self.ledger().select(F.explode("replaces").alias("batch"))
        return self.ledger().select("batch").distinct().join(gone, "batch", "left_anti")

    def _put(self, df: DataFrame, batch: str) -> None:
        """The rows of a batch, without an entry; days with most rows give several files of even size."""
        df.withColumn("snapshot_date", F.to_date(self.ts)).hint("rebalance", "snapshot_date").write.mode(
            "overwrite").partitionBy("snapshot_date").parquet(f"{self.path}/data/batch={batch}")

    def _enter(self, batch: str, replaces: list[str]) -> None:
        self.spark.createDataFrame([(batch, replaces)], "batch string, replaces array<string>").coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/ledger/{batch}")

    def append(self, df: DataFrame, batch: str) -> bool:
        """Write a batch under a name of letters, digits and dashes; False where it counts already."""
        name = self._name(batch)
        if not self.ledger().filter(F.col("batch") == name).isEmpty():
            return False
        self._put(df, name)
        self._enter(name, [])
        return True

    @staticmethod
    def _name(batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        # A letter in front keeps names that are numbers as they are.
        return f"b-{batch}"

    def read(self, schema: str | T.StructType | None = None) -> DataFrame:
        """Rows of all batches that count, with snapshot_date; ``schema`` is needed where no batch has rows."""
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if fields is not None and self.batches().isEmpty():
            return self.spark.createDataFrame([], T.StructType([*fields.fields, T.StructField("snapshot_date", T.DateType())]))
        reader = self.spark.read if fields is None else self.spark.read.schema(
            T.StructType([*fields.fields, T.StructField("batch", T.StringType()), T.StructField("snapshot_date", T.DateType())]))
        return reader.parquet(f"{self.path}/data").join(self.batches(), "batch", "left_semi").drop("batch")

    def compact(self, batch: str) -> None:
        """All batches that count now as one."""
        name, old = self._name(batch), sorted(r.batch for r in self.batches().collect())
        self._put(self.read().drop("snapshot_date"), name)
        self._enter(name, old)


def replace_state(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the next state to a new folder; readers switch to it once it is complete.

    A state table is never overwritten while it is being read, so a lost executor
    can always recompute from the previous state.
    """
    df.write.mode("errorifexists").format(fmt).save(path)


def retain_recent(scans: DataFrame, as_of: str, days: int = 30, ts: str = "created_at") -> DataFrame:
    """Scans not older than the cutoff."""
    return scans.filter(F.col(ts) >= before(scans, ts, as_of, days=days))


def retain_children(children: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Dependent rows whose parent was kept."""
    return children.join(kept.select(F.col("id").alias(key)), key, "left_semi")


def retain_last_n(scans: DataFrame, key: str = "competitor_id", ts: str = "created_at", n: int = 5,
                  tie: str = "id") -> DataFrame:
    """The ``n`` newest rows of each key."""
    return top_n_per_key(scans, [key], [F.col(ts).desc(), F.col(tie).desc()], n)

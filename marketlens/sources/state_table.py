"""State tables that take changes as small deltas: nothing that did not change is written again."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OWN = ("_hash", "_version", "_deleted")


class StateTable:
    """Rows by key, as a base and deltas in one parquet table bucketed and sorted by a hash of the key.

    A delta is an append of the rows that changed, so it costs what changed. Reading
    takes the newest version of each key, merged bucket by bucket without an exchange.
    A version is written once: the same version again, as after a failure, is left
    out. ``compact`` writes the rows that stand to a new folder, one file per bucket.
    Keys may hold nulls, which are equal to each other.
    """

    def __init__(self, spark: SparkSession, location: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64) -> None:
        clash = {c.lower() for c in schema.names} & set(OWN)
        if clash:
            raise ValueError(f"columns with reserved names: {sorted(clash)}")
        self.spark, self.location, self.schema, self.keys, self.buckets = spark, location.rstrip("/"), schema, list(keys), buckets
        self.table = "state_" + hashlib.md5(self.location.encode()).hexdigest()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (_hash BIGINT, {columns}, _version BIGINT, _deleted BOOLEAN) USING parquet "
            f"CLUSTERED BY (_hash) SORTED BY (_hash) INTO {buckets} BUCKETS LOCATION '{self.location}'")

    def key_hash(self) -> Column:
        return F.xxhash64(*[x for k in self.keys for x in (F.col(k).isNull(), F.col(k))])

    def _append(self, rows: DataFrame, version: int, deleted: Column) -> None:
        if not self.versions().filter(F.col("_version") == version).isEmpty():
            return
        rows.withColumn("_hash", self.key_hash()).select(
            "_hash", *self.schema.names, F.lit(version).cast("long"), deleted).repartition(
            self.buckets, "_hash").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def upsert(self, rows: DataFrame, version: int) -> None:
        """New state of the keys in ``rows``, one row each; ``version`` must be above all before."""
        self._append(rows, version, F.lit(False))

    def delete(self, keys: DataFrame, version: int) -> None:
        """Take out the keys; other columns of the marker are null."""
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in self.keys]
        self._append(keys.select(*self.keys, *empty), version, F.lit(True))

    def versions(self) -> DataFrame:
        """All rows that were ever written since the last compaction."""
        return self.spark.table(self.table)

    def _standing(self, rows: DataFrame) -> DataFrame:
        newest = Window.partitionBy("_hash", *self.keys).orderBy(F.desc("_version"))
        return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1 AND NOT _deleted").drop("_n")

    def current(self) -> DataFrame:
        """The state as it stands: one row per key."""
        return self._standing(self.versions()).select(*self.schema.names)

    def before(self, version: int) -> DataFrame:
        """The rows that stood when ``version`` was not yet written, with their ``_hash``."""
        return self._standing(self.versions().filter(F.col("_version") < version)).select("_hash", *self.schema.names)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows that stand for the keys in ``keys``; only these are dealt out."""
        wanted = keys.select(*self.keys).distinct().withColumn("_wanted", self.key_hash()).select(
            "_wanted", *[F.col(k).alias(f"_wanted_{k}") for k in self.keys]).hint("merge")
        rows = self.versions()
        same = rows["_hash"] == wanted["_wanted"]
        for k in self.keys:
            a, b = rows[k], wanted[f"_wanted_{k}"]
            same &= F.coalesce(a == b, a.isNull() & b.isNull())
        return self._standing(rows.join(wanted, same, "left_semi")).select(*self.schema.names)

    def compact(self, location: str) -> StateTable:
        """The state in a new folder; readers go over to it once it is complete."""
        out = StateTable(self.spark, location, self.schema, self.keys, self.buckets)
        self._standing(self.versions()).select("_hash", *self.schema.names, "_version", "_deleted").repartition(
            self.buckets, "_hash").write.insertInto(out.table)
        self.spark.catalog.refreshTable(out.table)
        return out

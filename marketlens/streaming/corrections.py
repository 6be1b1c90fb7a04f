"""Change streams that set right what they said before: rows may come in any order of time.

A lag over a stream is kept in three tables under one folder, all written batch by
batch and replaced where a batch is repeated:

- ``rows``: every row that has come, laid out by span of time,
- ``links``: rows of the spans that a batch reached, with what stood before them in
  their span; the first row of a span also says what its last one said,
- ``out``: rows with the value before them; a row whose predecessor changed is put out
  again under a newer version.

A batch reads the rows of its own keys in its own spans, and of other spans of these
keys only the first rows of ``links``. So a late row costs as much as one in time, and
a key with a long history costs no more than one of its spans. Rows are dealt out once
by a hash of key and span, the first rows once by a hash of the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketlens.plans.skew import top_n_per_key
from marketlens.session import scratch_dir

#: Working columns: batch and number of a row, its span, the version of what is put out.
OWN = ("_of", "_number", "_span", "_version")


class CorrectedLag:
    """Every row with the ``value`` that its key had before, by (time, tie), null times first.

    ``grain`` is the length of a span, a unit of ``date_trunc``: rows of one key in one
    span are sorted by one task. ``finish`` adds columns to rows that have ``name``, the
    value before, and ``known``, whether there is a row before.
    """

    def __init__(self, path: str, schema: T.StructType, keys: Sequence[str], time: str, tie: Sequence[str], value: str, name: str,
                 finish: Callable[[DataFrame], DataFrame] = lambda df: df, grain: str = "year") -> None:
        self.path, self.schema, self.keys, self.time, self.tie = path, schema, list(keys), time, list(tie)
        self.value, self.name, self.finish, self.grain = value, name, finish, grain
        clash = {c.lower() for c in schema.names} & {*OWN, name.lower(), "known"}
        if clash:
            raise ValueError(f"columns with reserved names: {sorted(clash)}")

    def _store(self, df: DataFrame, table: str, parts: Sequence[str]) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.path}/{table}")

    @staticmethod
    def _hash(columns: Sequence[str]) -> Column:
        return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one micro-batch; the same batch again changes nothing."""
        spark = batch.sparkSession
        # Rows alike in time and tie stand in the order they came in.
        order = [self.time, *self.tie, "_of", "_number"]
        span = F.coalesce(F.date_format(F.date_trunc(self.grain, F.col(self.time)), "yyyyMMddHH"), F.lit("0"))
        arrived = batch.withColumns({
            "_number": F.monotonically_increasing_id(), "_of": F.lit(batch_id), "_span": span})
        self._store(arrived.hint("rebalance", "_span"), "rows", ["_of", "_span"])
        rows = spark.read.schema(arrived.schema).parquet(f"{self.path}/rows").filter(F.col("_of") <= batch_id)
        new = rows.filter(F.col("_of") == batch_id)
        low, high = new.agg(F.min("_span"), F.max("_span")).first()
        if low is None:
            return
        columns = rows.columns

        def within(*names: str) -> list[Column]:
            return [F.col("row")[c] for c in names]

        # Joined by hashes alone: a key of an equal hash would be worked out again and say the same.
        place, key = self._hash([*self.keys, "_span"]), self._hash(self.keys)
        here = rows.filter(F.col("_span").between(low, high)).select(F.struct(*columns).alias("row"), place.alias("place")).join(
            new.select(place.alias("place")).distinct(), "place", "left_semi")
        along = Window.partitionBy("place", *within(*self.keys, "_span")).orderBy(*within(*order))
        said = F.struct(F.col("row")[self.value].alias("v"), F.col("row")["_of"].alias("of"))
        whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        linked = here.select("row", F.lag(said).over(along).alias("before"), F.last(said).over(whole).alias("last_said"))
        ours = (F.col("row")["_of"] == batch_id) | (F.col("before.of") == batch_id)
        first = F.col("before").isNull()
        links = linked.filter(first | ours).select(
            "row", "before", F.when(first, F.col("last_said")).alias("last_said"), first.cast("int").alias("_first"))
        links.write.mode("overwrite").partitionBy("_first").parquet(f"{self.path}/links/_version={batch_id}")

        known = spark.read.schema(T.StructType([*links.schema.fields, T.StructField("_version", T.IntegerType())])).parquet(
            f"{self.path}/links").filter(F.col("_version") <= batch_id)
        ends = known.filter("_first = 1").select("row", "last_said", "_version").withColumn(
            "key", self._hash([f"row.`{k}`" for k in self.keys])).join(
            new.select(key.alias("key")).distinct(), "key", "left_semi")
        newest = Window.partitionBy("key", *within(*self.keys, "_span")).orderBy(F.desc("_version"))
        spans = Window.partitionBy("key", *within(*self.keys)).orderBy(*within("_span"))
        chain = ends.withColumn("n", F.row_number().over(newest)).filter("n = 1").select(
            "row", "last_said", "_version", F.lag("last_said").over(spans).alias("earlier"),
            F.lead("row").over(spans).alias("next"), F.lead("_version").over(spans).alias("next_version"))
        # The first row of a later span that the batch did not reach gets a new predecessor too.
        moved = chain.filter(F.col("_version") == batch_id).select(F.inline(F.array_compact(F.array(
            F.struct("row", F.col("earlier").alias("before")),
            F.when(F.col("next_version") < batch_id, F.struct(F.col("next").alias("row"), F.col("last_said").alias("before")))))))
        inside = known.filter((F.col("_version") == batch_id) & (F.col("_first") == 0)).select("row", "before")
        changed = inside.unionByName(moved).filter(ours).select(
            *[F.col("row")[c].alias(c) for c in columns], F.col("before.v").alias(self.name),
            F.col("before").isNotNull().alias("known"), F.lit(batch_id).alias("_version"))
        self._store(self.finish(changed), "out", ["_version"])

    def _columns_out(self, spark: SparkSession) -> T.StructType:
        fields = [*self.schema.fields, T.StructField("_of", T.IntegerType()), T.StructField("_number", T.LongType()),
                  T.StructField("_span", T.StringType()), T.StructField(self.name, self.schema[self.value].dataType),
                  T.StructField("known", T.BooleanType()), T.StructField("_version", T.IntegerType())]
        return self.finish(spark.createDataFrame([], T.StructType(fields))).schema

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run over all data present; further runs with the same checkpoint go on from there."""
        spark = stream.sparkSession
        spark.createDataFrame([], self._columns_out(spark)).write.mode("append").parquet(f"{self.path}/out")
        return (
            stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )

    def versions(self, spark: SparkSession) -> DataFrame:
        """All that was put out, ``_version`` telling the batch; a row that stands again corrects the one before."""
        return spark.read.schema(self._columns_out(spark)).parquet(f"{self.path}/out")

    def current(self, spark: SparkSession) -> DataFrame:
        """Every row as it stands now; equal to the batch form over all rows."""
        return top_n_per_key(self.versions(spark), ["_of", "_number"], [F.col("_version").desc()], 1).drop(*OWN)


def settle(stream: DataFrame, purpose: str, make: Callable[[str, T.StructType], CorrectedLag]) -> DataFrame:
    """Run a stream over all data present, in the shared scratch folder, and return the rows as they stand."""
    base = scratch_dir(stream.sparkSession, purpose)
    lag = make(f"{base}/tables", stream.schema)
    lag.start(stream, f"{base}/checkpoint").awaitTermination()
    return lag.current(stream.sparkSession)

"""Keyed state that remembers the last value seen: the core of every change stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketlens.sources.state_table import StateTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What the state holds of a key.
_STATE = T.StructType([T.StructField("_last_at", T.LongType()), T.StructField("_last_value", T.StringType())])


class ChangeStream:
    """A stream whose rows get the value their key had before, micro-batch by micro-batch.

    The last value of each key stands in a :class:`StateTable` under the folder of the
    run. A batch is joined with it and linked by a window, all in columns; what it puts
    out is written first, and the state is taken from what was written, so a repeated
    batch gives the same.
    """

    def __init__(self, stream: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], value: str, name: str, late: str,
                 finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        self.stream, self.keys, self.time, self.tie = stream, list(keys), time, list(tie)
        self.value, self.name, self.late, self.finish = value, name, late, finish
        self.sparkSession = stream.sparkSession

    def then(self, step: Callable[[DataFrame], DataFrame]) -> ChangeStream:
        """The same stream with columns made from the linked rows."""
        return ChangeStream(self.stream, self.keys, self.time, self.tie, self.value, self.name, self.late,
                            lambda df: step(self.finish(df)))

    def _linked(self, batch: DataFrame, state: StateTable, batch_id: int) -> DataFrame:
        # Microseconds compare alike in rows and in state, whatever the zone.
        rows = batch.withColumns({
            "_value": F.struct(F.col(self.value).cast("string").alias("v")),
            "_at": F.unix_micros(F.col(self.time).cast("timestamp")), "_hash": state.key_hash(),
            # Rows alike in time and tie stand in the order they came in.
            "_number": F.monotonically_increasing_id()})
        known = state.before(batch_id).select(
            F.col("_hash").alias("_known"), *[F.col(k).alias(f"_known_{k}") for k in self.keys], "_last_at",
            F.struct(F.col("_last_value").alias("v")).alias("_last")).hint("merge")
        same = rows["_hash"] == known["_known"]
        for k in self.keys:
            a, b = rows[k], known[f"_known_{k}"]
            # Not a null-safe equality: that would join by the key and deal the table out by it.
            same &= F.coalesce(a == b, a.isNull() & b.isNull())
        late = F.col("_last_at").isNotNull() & (F.col("_at").isNull() | (F.col("_at") < F.col("_last_at")))
        joined = rows.join(known, same, "left").withColumn(self.late, F.coalesce(late, F.lit(False)))
        along = Window.partitionBy("_hash", *self.keys, self.late).orderBy("_at", *self.tie, "_number")
        return joined.withColumns({
            self.name: F.when(~F.col(self.late), F.coalesce(F.lag("_value").over(along), "_last")["v"]),
            "_newest": ~F.col(self.late) & F.lead("_value").over(along).isNull()}).select(
            *batch.columns, self.name, self.late, F.col("_at").alias("_last_at"), F.col("_value.v").alias("_last_value"), "_newest")

    def start(self, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
        """Run over all data present; further runs with the same folders and buckets go on from there."""
        spark = self.sparkSession
        state = StateTable(spark, f"{path}/state", T.StructType([
            *[self.stream.schema[k] for k in self.keys], *_STATE]), self.keys, buckets)

        def write(batch: DataFrame, batch_id: int) -> None:
            folder = f"{path}/out/{batch_id:012d}"
            self._linked(batch, state, batch_id).write.mode("overwrite").parquet(folder)
            state.upsert(spark.read.schema(self._columns()).parquet(folder).filter("_newest"), batch_id)

        spark.createDataFrame([], self._columns()).write.mode("overwrite").parquet(f"{path}/out/none")
        return (
            self.stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )

    def _columns(self) -> T.StructType:
        return T.StructType([
            *self.stream.schema.fields, T.StructField(self.name, T.StringType()), T.StructField(self.late, T.BooleanType()),
            *_STATE, T.StructField("_newest", T.BooleanType())])

    def written(self, path: str) -> DataFrame:
        """All rows that were put out so far."""
        linked = self.sparkSession.read.schema(self._columns()).parquet(f"{path}/out/*")
        return self.finish(linked.drop(*_STATE.names, "_newest"))


def with_previous_stream(stream: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], value: str,
                         name: str, late: str = "late") -> ChangeStream:
    """Streaming form of a lag: every row with the ``value`` its key had before, as text.

    A row older than the stored one of its key says nothing about the present: it is
    marked in ``late``, has no value before it and leaves the state as it is. No row
    is lost; :func:`late_rows` and :func:`rows_in_time` tell the two apart. Within a
    micro-batch rows are taken in (time, tie) order, nulls first. Where late rows have
    to set right what was said before, take ``corrections.CorrectedLag``. Hand over
    narrow rows: all columns are dealt out by key.
    """
    return ChangeStream(stream, keys, time, tie, value, name, late)


def late_rows(linked: DataFrame, late: str = "late") -> DataFrame:
    """The side output: rows that came after a newer one of their key."""
    return linked.filter(late)


def rows_in_time(linked: DataFrame, late: str = "late") -> DataFrame:
    return linked.filter(~F.col(late))

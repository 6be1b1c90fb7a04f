"""Running streams: bounded reads, exactly-once folders, alert routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketlens.session import scratch_dir
from marketlens.streaming.previous import ChangeStream
from marketlens.streaming.progress import ScanProgress
from marketlens.streaming.seen import FirstArrivals

CHANNELS = {"scan_progress": "scans", "new_alert": "alerts", "competitor_update": "competitors"}


def read_stream(spark: SparkSession, directory: str, schema: str, files: str | None = None,
                per_trigger: int = 1000) -> DataFrame:
    """Parquet files as a stream with a stated schema and a bound on files per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(per_trigger))
    if files:
        reader = reader.option("pathGlobFilter", files)
    return reader.parquet(directory)


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write an append stream to parquet; the sink's log makes each batch count once."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write changed rows of every batch to their own folder; a repeated batch replaces its folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/{batch_id:012d}")

    return (
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def route_alerts(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Send messages to their channel by kind, one folder per channel.

    ``events`` has a ``kind`` (scan_progress, new_alert, competitor_update) and a
    struct ``data``. Kinds without a channel are left out. A batch is written in
    one pass, laid out by channel.
    """
    channel = F.create_map(*[F.lit(x) for pair in CHANNELS.items() for x in pair])[F.col("kind")]
    messages = events.withColumn("channel", channel).filter(F.col("channel").isNotNull()).select(
        "channel", F.to_json(F.struct(F.col("kind").alias("type"), "data")).alias("message"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("channel").parquet(f"{path}/batch={batch_id}")

    return (
        messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def drain(stream: DataFrame | ChangeStream | FirstArrivals | ScanProgress, purpose: str, mode: str = "append") -> DataFrame:
    """Run a stream over all data present and return what it wrote, from the shared scratch folder.

    ``mode`` is for plain streams; the others write in their own way.
    """
    spark = stream.sparkSession
    base = scratch_dir(spark, purpose)
    if not isinstance(stream, DataFrame):
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        stream.start(base, f"{base}/checkpoint", buckets).awaitTermination()
        return stream.written(base)
    if mode == "append":
        append_stream(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    upsert_stream(stream, f"{base}/out", f"{base}/checkpoint", mode).awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{base}/out/*")

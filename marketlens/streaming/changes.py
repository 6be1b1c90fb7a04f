"""Change detection on arriving snapshots, with the rules of the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions import text as tx
from marketlens.functions.prices import percent_change
from marketlens.operators.changes import MIN_CONTENT_CHARS, content_status
from marketlens.operators.prices import price_status
from marketlens.streaming.corrections import CorrectedLag
from marketlens.streaming.previous import ROCKSDB, ChangeStream, with_previous_stream
from marketlens.streaming.progress import ScanProgress
from marketlens.streaming.seen import FirstArrivals


def stream_price_changes(snapshots: DataFrame, keys: Sequence[str] = ("competitor_id", "product_name"),
                         time: str = "captured_at", tie: Sequence[str] = ("id",), min_pct: float = 1.0) -> ChangeStream:
    """Price captures with the price before, status and percent change; late ones have status ``late``."""
    status = F.when(F.col("late"), "late").otherwise(price_status(F.col("old_price"), F.col("price"), min_pct))
    return with_previous_stream(snapshots, keys, time, tie, "price", "old_price").then(lambda linked: linked.withColumn(
        "old_price", F.col("old_price").cast("decimal(12,2)")).withColumns({
            "status": status,
            "change_percentage": F.when(status.isin("increase", "decrease"), F.bround(
                percent_change(F.col("old_price"), F.col("price")), 2).cast("decimal(10,2)"))}))


def stream_content_changes(pages: DataFrame, keys: Sequence[str] = ("competitor_id", "url"),
                           time: str = "checked_at", tie: Sequence[str] = ()) -> ChangeStream:
    """Pages with hash, length and a status against the text the page had before.

    Short texts are left out, late pages have status ``late``. Texts are hashed
    before rows are dealt out: neither the shuffle nor the state sees them.
    """
    hashed = pages.filter(F.length("text_content") >= MIN_CONTENT_CHARS).select(
        *[c for c in pages.columns if c != "text_content"], F.length("text_content").alias("char_count"),
        tx.content_hash(F.col("text_content")).alias("new_hash"))
    known = F.col("old_hash").isNotNull()
    status = content_status(F.col("char_count"), F.col("new_hash"), F.col("old_hash"), known)
    return with_previous_stream(hashed, keys, time, tie, "new_hash", "old_hash").then(
        lambda linked: linked.withColumn("status", F.when(F.col("late"), "late").otherwise(status)))


def stream_product_changes(cards: DataFrame, keys: Sequence[str] = ("competitor_id", "name"),
                           time: str = "checked_at", tie: Sequence[str] = ()) -> ChangeStream:
    """Product cards with a status against description and availability seen before.

    An unknown availability is a value of its own that differs from no other, as in
    the batch form; late cards have status ``late``.
    """
    shown = F.coalesce(F.col("is_available").cast("string"), F.lit(""))
    hashed = cards.withColumn("description_hash", F.sha2(F.coalesce("description", F.lit("")), 256)).withColumn(
        "_card", F.concat("description_hash", F.lit("|"), shown))
    old_hash, old_shown = F.substring_index("_old", "|", 1), F.substring_index("_old", "|", -1)
    differs = (old_hash != F.col("description_hash")) | F.coalesce(
        F.nullif(old_shown, F.lit("")) != F.nullif(shown, F.lit("")), F.lit(False))
    return with_previous_stream(hashed.drop("description"), keys, time, tie, "_card", "_old").then(
        lambda linked: linked.withColumns({
            "status": F.when(F.col("late"), "late").when(F.col("_old").isNull(), "new").when(differs, "updated")
            .otherwise("unchanged"),
            "went_unavailable": F.coalesce((old_shown == "true") & ~F.col("is_available"), F.lit(False)),
        }).drop("_card", "_old"))


def price_corrections(path: str, schema: T.StructType, keys: Sequence[str] = ("competitor_id", "product_name"),
                      time: str = "captured_at", tie: Sequence[str] = ("id",), min_pct: float = 1.0) -> CorrectedLag:
    """Price captures as in :func:`stream_price_changes`, late ones setting right the captures after them."""
    def finish(linked: DataFrame) -> DataFrame:
        status = price_status(F.col("old_price"), F.col("price"), min_pct)
        return linked.withColumns({"status": status, "change_percentage": F.when(
            status.isin("increase", "decrease"), F.bround(percent_change(F.col("old_price"), F.col("price")), 2).cast(
                "decimal(10,2)"))}).drop("known")

    return CorrectedLag(path, schema, keys, time, tie, "price", "old_price", finish)


def hashed_pages(pages: DataFrame) -> DataFrame:
    """Pages with a length and a hash instead of their texts; short ones are left out."""
    return pages.filter(F.length("text_content") >= MIN_CONTENT_CHARS).select(
        *[c for c in pages.columns if c != "text_content"], F.length("text_content").alias("char_count"),
        tx.content_hash(F.col("text_content")).alias("new_hash"))


def content_corrections(path: str, schema: T.StructType, keys: Sequence[str] = ("competitor_id", "url"),
                        time: str = "checked_at", tie: Sequence[str] = ()) -> CorrectedLag:
    """Pages of :func:`hashed_pages` with a status against the text before, set right by late ones."""
    def finish(linked: DataFrame) -> DataFrame:
        return linked.withColumn("status", content_status(
            F.col("char_count"), F.col("new_hash"), F.col("old_hash"), F.col("known"))).drop("known")

    return CorrectedLag(path, schema, keys, time, tie, "new_hash", "old_hash", finish)


def hashed_cards(cards: DataFrame) -> DataFrame:
    """Product cards with a hash instead of their description, and what is compared in one column."""
    return cards.withColumn("description_hash", F.sha2(F.coalesce("description", F.lit("")), 256)).withColumn(
        "card", F.struct("description_hash", "is_available")).drop("description")


def product_corrections(path: str, schema: T.StructType, keys: Sequence[str] = ("competitor_id", "name"),
                        time: str = "checked_at", tie: Sequence[str] = ()) -> CorrectedLag:
    """Cards of :func:`hashed_cards` with a status against the card before, set right by late ones."""
    def finish(linked: DataFrame) -> DataFrame:
        differs = (F.col("old_card.description_hash") != F.col("description_hash")) | F.coalesce(
            F.col("old_card.is_available") != F.col("is_available"), F.lit(False))
        return linked.withColumns({
            "status": F.when(~F.col("known"), "new").when(differs, "updated").otherwise("unchanged"),
            "went_unavailable": F.coalesce(F.col("old_card.is_available") & ~F.col("is_available"), F.lit(False)),
        }).drop("card", "old_card", "known")

    return CorrectedLag(path, schema, keys, time, tie, "card", "old_card", finish)


def changes_per_day(changes: DataFrame, time: str = "detected_at", delay: str | None = None) -> DataFrame:
    """Changes per 24 hours; run in update mode.

    The state is one number per day, so by default all of it is kept and a change
    counts however late it comes. With a ``delay`` a day is final, and later changes
    are left out, once the watermark has passed it.
    """
    stamped = changes.withColumn(time, F.col(time).cast("timestamp"))
    stamped = stamped if delay is None else stamped.withWatermark(time, delay)
    return (
        stamped.groupBy(F.window(time, "24 hours")).agg(F.count(F.lit(1)).alias("changes"))
        .select(F.col("window.start").alias("day_start"), F.col("window.end").alias("day_end"), "changes")
    )


def compare_days(days: DataFrame) -> DataFrame:
    """Percent change of each finished day against the one before. There is one row per day."""
    before = days.select(F.col("day_end").alias("day_start"), F.col("changes").alias("previous"))
    now, previous = F.col("changes"), F.coalesce("previous", F.lit(0))
    return days.join(before, "day_start", "left").withColumn(
        "change", F.coalesce(F.bround(F.try_divide(now - previous, previous) * 100, 1),
                             F.when(now == 0, 0.0).otherwise(100.0))).drop("previous")


def scan_progress(pages: DataFrame, totals: DataFrame, time: str = "crawled_at", tie: Sequence[str] = ()) -> ScanProgress:
    """Pages crawled, newest url and progress per scan; each micro-batch puts out the scans it touched.

    ``totals`` (scan_id, total) is fixed when the scan starts. Progress stays at
    100 when more pages turn up.
    """
    return ScanProgress(pages, totals, time, tie)


def dedupe_pages(pages: DataFrame, time: str = "crawled_at", delay: str | None = None) -> DataFrame | FirstArrivals:
    """First arrival of each url of a scan.

    By default every url is remembered, in a table, and none is lost, in any order
    of time; of one micro-batch the oldest row of a url counts. With a ``delay`` only
    repeats within it are known, and pages older than the watermark are left out.
    """
    stamped = pages.withColumn(time, F.col(time).cast("timestamp"))
    if delay is None:
        return FirstArrivals(stamped, ["scan_id", "url"], time)
    # The urls of the delay stay in the state: on disk, not in the executors' heap.
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stamped.withWatermark(time, delay).dropDuplicatesWithinWatermark(["scan_id", "url"])

"""Filtered lists, newest first, and per-entity statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.text import CATEGORY_URL_PARTS
from marketlens.functions.times import before
from marketlens.plans.skew import latest_per_key, top_n_per_key


def _filtered(df: DataFrame, **equal) -> DataFrame:
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def _page(df: DataFrame, order: str, skip: int, limit: int | None) -> DataFrame:
    """Newest first; ids break ties so that pages never overlap. Without a limit all rows after ``skip``."""
    ordered = df.orderBy(F.col(order).desc(), F.col("id").desc())
    ordered = ordered.offset(skip) if skip else ordered
    return ordered if limit is None else ordered.limit(limit)


def _names(competitors: DataFrame) -> DataFrame:
    return competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"))


def list_competitors(competitors: DataFrame, competitor_type: str | None = None,
                     is_monitoring: bool | None = None, skip: int = 0, limit: int | None = 50) -> DataFrame:
    active = _filtered(competitors.filter("is_active"), competitor_type=competitor_type,
                       is_monitoring=is_monitoring)
    return _page(active, "created_at", skip, limit)


def search_competitors(competitors: DataFrame, text: str = "", competitor_type: str | None = None) -> DataFrame:
    """Name or domain contains the text, in any case."""
    wanted = F.lit(text.lower())
    hit = F.contains(F.lower("name"), wanted) | F.contains(F.lower("domain"), wanted)
    return _filtered(competitors, competitor_type=competitor_type).filter(hit)


def list_content(contents: DataFrame, competitor_id=None, content_type: str | None = None,
                 has_changed: bool | None = None, limit: int | None = 100) -> DataFrame:
    return _page(_filtered(contents, competitor_id=competitor_id, content_type=content_type,
                           has_changed=has_changed), "last_checked", 0, limit)


def content_changes(changes: DataFrame, contents: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` changes of every competitor."""
    owners = contents.select(F.col("id").alias("content_id"), "competitor_id")
    return top_n_per_key(changes.join(owners, "content_id"), ["competitor_id"],
                         [F.col("detected_at").desc(), F.col("id").desc()], n)


def latest_change_per_page(contents: DataFrame, changes: DataFrame) -> DataFrame:
    """Old and new text of each page's newest change; pages without one keep their row."""
    newest = latest_per_key(changes, ["content_id"], "detected_at", "id").select(
        F.col("content_id").alias("id"), "old_value", "new_value", "detected_at")
    return contents.join(newest, "id", "left").select(
        F.col("id").alias("content_id"), "url", "title", F.col("old_value").alias("old_content"),
        F.col("new_value").alias("new_content"), F.coalesce("detected_at", "last_checked").alias("detected_at"))


def list_products(products: DataFrame, competitor_id=None, category: str | None = None,
                  is_available: bool | None = None, is_new: bool | None = None,
                  limit: int | None = 100) -> DataFrame:
    return _page(_filtered(products, competitor_id=competitor_id, category=category,
                           is_available=is_available, is_new=is_new), "last_checked", 0, limit)


def product_counts(products: DataFrame) -> DataFrame:
    """New and unavailable products per competitor."""
    return products.groupBy("competitor_id").agg(
        F.count(F.lit(1)).alias("products"), F.count_if("is_new").alias("new"),
        F.count_if(~F.col("is_available")).alias("unavailable"))


def product_detail(products: DataFrame, features: DataFrame) -> DataFrame:
    """Each product with its features, one row per feature; products without any keep one row."""
    rows = features.select(
        F.col("product_id").alias("id"), "feature_name", "feature_value", "feature_category")
    return products.join(rows, "id", "left")


def new_products(products: DataFrame, competitors: DataFrame, as_of: str, days: int = 7,
                 limit: int | None = 50) -> DataFrame:
    recent = products.filter(F.col("first_seen") >= before(products, "first_seen", as_of, days=days))
    named = recent.join(_names(competitors), "competitor_id")
    return _page(named, "first_seen", 0, limit).select(
        "id", "competitor_name", "name", "url", "category", "image_url", "first_seen")


def product_categories(products: DataFrame, competitor_id=None) -> DataFrame:
    return (
        _filtered(products, competitor_id=competitor_id).filter(F.col("category").isNotNull())
        .select("category").distinct()
    )


def list_alerts(alerts: DataFrame, is_read: bool | None = None, severity: str | None = None,
                alert_type: str | None = None, competitor_id=None, limit: int | None = 50) -> DataFrame:
    """Alerts not dismissed, newest first."""
    kept = _filtered(alerts.filter(~F.col("is_dismissed")), is_read=is_read, severity=severity,
                     alert_type=alert_type, competitor_id=competitor_id)
    return _page(kept, "created_at", 0, limit)


def recent_alerts(alerts: DataFrame, n: int = 5) -> DataFrame:
    return list_alerts(alerts, limit=n)


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Total, unread and per-severity counts in a single pass."""
    severity = F.col("severity")
    return alerts.filter(~F.col("is_dismissed")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_read")).alias("unread"),
        *[F.count_if(severity == s).alias(s) for s in ("critical", "high", "medium", "low")])


def unread_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(~F.col("is_dismissed") & ~F.col("is_read")).alias("count"))


def list_scans(scans: DataFrame, competitor_id=None, status: str | None = None, skip: int = 0,
               limit: int | None = 50) -> DataFrame:
    return _page(_filtered(scans, competitor_id=competitor_id, status=status), "created_at", skip, limit)


def scan_history(scans: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` scans of every competitor."""
    return top_n_per_key(scans, ["competitor_id"], [F.col("created_at").desc(), F.col("id").desc()], n)


def running_scans(scans: DataFrame, competitors: DataFrame) -> DataFrame:
    return scans.filter("status = 'running'").join(_names(competitors), "competitor_id").select(
        "id", "competitor_id", "competitor_name", "status", "progress", "pages_crawled", "pages_discovered",
        "current_url", "started_at", "created_at")


def _duration() -> Column:
    return F.expr("CAST(CAST(completed_at - started_at AS INTERVAL SECOND) AS BIGINT)")


def scan_detail(scans: DataFrame, competitors: DataFrame) -> DataFrame:
    """Scans with duration and, once complete, pages per minute."""
    timed = scans.join(_names(competitors), "competitor_id").withColumn("duration_seconds", _duration())
    minutes = F.col("duration_seconds") / F.lit(60)
    rate = F.when(F.col("duration_seconds") > 0, F.bround(F.try_divide(F.col("pages_crawled"), minutes), 2))
    return timed.withColumn("pages_per_minute", rate)


def scan_pages(pages: DataFrame, scan_id=None, skip: int = 0, limit: int = 100,
               tie: Sequence[str] = ("id",)) -> DataFrame:
    """Newest pages of one scan, or of every scan, ``limit`` each."""
    order = [F.col(c).desc() for c in ("crawled_at", *tie)]
    ranked = top_n_per_key(_filtered(pages, scan_id=scan_id), ["scan_id"], order, skip + limit, rank="_pos")
    return ranked.filter(F.col("_pos") > skip).drop("_pos")


def scan_stats(scans: DataFrame) -> DataFrame:
    """Totals by status, pages, mean pages (one decimal) and mean duration of completed scans."""
    n, status = F.count(F.lit(1)), F.col("status")
    done = F.when(status == "completed", _duration())
    return scans.agg(
        n.alias("total_scans"), F.count_if(status == "completed").alias("completed_scans"),
        F.count_if(status == "running").alias("running_scans"),
        F.count_if(status == "failed").alias("failed_scans"),
        F.coalesce(F.sum("pages_crawled"), F.lit(0)).alias("total_pages_crawled"),
        F.coalesce(F.bround(F.try_divide(F.sum("pages_crawled"), n), 1), F.lit(0.0)).alias("avg_pages_per_scan"),
        F.bround(F.try_divide(F.sum(done), F.count(done)), 1).alias("avg_duration_seconds"))


def content_stats(contents: DataFrame) -> DataFrame:
    """Pages, words, floored mean words, changed pages and a count per page category."""
    n, words, kind = F.count(F.lit(1)), F.sum("word_count"), F.col("content_type")
    categories = [label for label, _ in CATEGORY_URL_PARTS] + ["landing", "other"]
    return contents.groupBy("competitor_id").agg(
        n.alias("total_pages"), words.alias("total_words"), F.expr("sum(word_count) div count(1)")
        .alias("average_words"), F.count_if("has_changed").alias("changed_pages"),
        *[F.count_if(kind == c).alias(f"{c}_pages") for c in categories])


def due_for_monitoring(competitors: DataFrame, scans: DataFrame) -> DataFrame:
    """Active, monitored competitors without a running scan."""
    busy = scans.filter("status = 'running'").select(F.col("competitor_id").alias("id"))
    return competitors.filter("is_active AND is_monitoring").join(busy, "id", "left_anti")


def scan_rollup(pages: DataFrame, scans: DataFrame) -> DataFrame:
    """Scans with the number of pages found for them; such scans are complete."""
    counted = pages.groupBy(F.col("scan_id").alias("id")).agg(F.count(F.lit(1)).alias("_pages"))
    found = F.col("_pages").isNotNull()
    return scans.join(counted, "id", "left").withColumns({
        "pages_crawled": F.coalesce("_pages", F.lit(0)),
        "progress": F.when(found, 100).otherwise(F.col("progress")),
        "status": F.when(found, "completed").otherwise(F.col("status")),
    }).drop("_pages")

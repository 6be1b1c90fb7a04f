"""Head-line numbers: one conditional aggregate per table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.times import before, instant


def _metric(df: DataFrame, label: str, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("value")).select(
        F.lit(label).alias("label"), "value",
        F.lit(None).cast("double").alias("change"), F.lit(None).cast("string").alias("change_direction"))


def dashboard_metrics(competitors: DataFrame, changes: DataFrame, scans: DataFrame, alerts: DataFrame,
                      as_of: str) -> DataFrame:
    """Four labelled numbers; changes are compared with the 24 hours before."""
    at = F.col("detected_at")
    day, two_days = (before(changes, "detected_at", as_of, hours=h) for h in (24, 48))
    window = changes.filter((at >= two_days) & (at <= instant(changes, "detected_at", as_of)))
    counts = window.agg(F.count_if(at >= day).alias("value"), F.count_if(at < day).alias("previous"))
    now, previous = F.col("value"), F.col("previous")
    pct = F.coalesce(
        F.bround(F.try_divide(now - previous, previous) * 100, 1),
        F.when(now == 0, 0.0).otherwise(100.0))
    moved = counts.select(
        F.lit("Changes (24h)").alias("label"), "value", F.abs(pct).alias("change"),
        F.when(pct > 0, "up").when(pct < 0, "down").otherwise("neutral").alias("change_direction"))
    return reduce(DataFrame.unionByName, [
        _metric(competitors, "Total Competitors", F.col("is_active")),
        moved,
        _metric(scans, "Active Monitors", F.col("status") == "running"),
        _metric(alerts, "Critical Alerts", ~F.col("is_read") & F.col("severity").isin("high", "critical")),
    ])


def activity_feed(changes: DataFrame, contents: DataFrame, competitors: DataFrame, n: int = 10) -> DataFrame:
    """Newest content changes with the competitor's name."""
    owners = contents.select(F.col("id").alias("content_id"), "competitor_id")
    names = competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"))
    kind = F.col("change_type")
    return (
        changes.join(owners, "content_id").join(names, "competitor_id")
        .orderBy(F.col("detected_at").desc(), F.col("id").desc()).limit(n)
        .select("id", kind.alias("type"), F.concat(F.lit("Content "), kind).alias("title"),
                F.concat("field_changed", F.lit(" was "), kind).alias("description"),
                "competitor_name", F.col("detected_at").alias("timestamp"))
    )


def health_breakdown(competitors: DataFrame) -> DataFrame:
    """Truncated mean health of active competitors and how many are strong, neutral or weak."""
    score = F.col("health_score")
    return competitors.filter("is_active").agg(
        F.coalesce(F.avg(score), F.lit(0.0)).cast("int").alias("overall_score"),
        F.count_if(score >= 70).alias("strengths"),
        F.count_if((score >= 40) & (score < 70)).alias("neutrals"),
        F.count_if(score < 40).alias("alerts"))


def current_scan(scans: DataFrame) -> DataFrame:
    """The running scan that started last."""
    return (
        scans.filter("status = 'running'").orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(1)
        .select("id", "progress", "current_url", "pages_crawled", "pages_discovered")
    )


def entity_counts(competitors: DataFrame, scans: DataFrame, contents: DataFrame, alerts: DataFrame) -> DataFrame:
    """Row counts per entity, as (entity, rows)."""
    def counted(df: DataFrame, name: str, condition: Column) -> DataFrame:
        return df.agg(F.count_if(condition).alias("rows")).select(F.lit(name).alias("entity"), "rows")

    return reduce(DataFrame.unionByName, [
        counted(competitors, "competitors", F.col("is_active")),
        counted(scans, "scans", F.lit(True)),
        counted(contents, "contents", F.lit(True)),
        counted(alerts, "unread_alerts", ~F.col("is_read")),
    ])

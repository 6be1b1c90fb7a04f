"""Price history: changes, latest prices, comparisons and deals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.prices import percent_change
from marketlens.functions.times import before
from marketlens.plans.skew import latest_per_key, with_previous

KEYS = ("competitor_id", "product_name")


def price_status(old: Column, new: Column, min_pct: float = 1.0) -> Column:
    """new / unchanged / increase / decrease for a price and the one before it."""
    moved = F.abs(new - old) * 100 >= old * F.lit(min_pct).cast("decimal(6,2)")
    return (
        F.when(old.isNull(), "new")
        .when((old == new) | ~moved, "unchanged")
        .when(new > old, "increase")
        .otherwise("decrease")
    )


def detect_price_changes(history: DataFrame, keys: Sequence[str] = KEYS, ts: str = "captured_at",
                         tie: Sequence[str] = ("id",), min_pct: float = 1.0, **skew) -> DataFrame:
    """Every capture with the price before it, the percent change and a status."""
    linked = with_previous(history, keys, ts, tie, F.col("price"), "old_price", **skew)
    old, new = F.col("old_price"), F.col("price")
    status = price_status(old, new, min_pct)
    return linked.withColumns({
        "status": status,
        "change_percentage": F.when(status.isin("increase", "decrease"),
                                    F.bround(percent_change(old, new), 2).cast("decimal(10,2)")),
    })


def price_alerts(changes: DataFrame) -> DataFrame:
    """Alert rows for first captures and for moves past the threshold."""
    return changes.filter("status <> 'unchanged'").select(
        "competitor_id", "product_name", "old_price", F.col("price").alias("new_price"),
        F.col("status").alias("change_type"), "change_percentage",
        F.col("product_url").alias("url"), F.lit(False).alias("is_read"),
        F.col("captured_at").alias("created_at"),
    )


def price_change_summary(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of new, updated and unchanged captures."""
    status = F.col("status")
    return changes.groupBy(*by).agg(
        F.count_if(status == "new").alias("new"),
        F.count_if(status.isin("increase", "decrease")).alias("updated"),
        F.count_if(status == "unchanged").alias("unchanged"),
    )


def latest_prices(history: DataFrame, keys: Sequence[str] = KEYS, ts: str = "captured_at",
                  tie: Sequence[str] = ("id",), limit: int | None = None) -> DataFrame:
    """Newest capture per product; ``limit`` keeps that many products in name order."""
    newest = latest_per_key(history, keys, ts, *tie)
    return newest if limit is None else newest.orderBy(*keys).limit(limit)


def price_series(history: DataFrame, as_of: str, days: int = 30, product: str | None = None) -> DataFrame:
    """Captures of the last ``days`` days, for one product or for all; sort by time within a product for its series."""
    recent = history.filter(F.col("captured_at") >= before(history, "captured_at", as_of, days=days))
    if product is not None:
        recent = recent.filter(F.col("product_name") == product)
    return recent.select("competitor_id", "product_name", "captured_at", "price", "currency")


def compare_prices(history: DataFrame, competitors: DataFrame, text: str, ids: Sequence | None = None,
                   ts: str = "captured_at", tie: Sequence[str] = ("id",)) -> DataFrame:
    """Per competitor the newest price of a product whose name contains ``text``."""
    named = history.filter(F.contains(F.lower("product_name"), F.lit(text.lower())))
    if ids is not None:
        named = named.filter(F.col("competitor_id").isin(list(ids)))
    newest = latest_per_key(named, ["competitor_id"], ts, *tie)
    names = competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"))
    return newest.join(names, "competitor_id").select(
        "competitor_id", "competitor_name", "product_name", "price", "currency", "is_on_sale",
        "discount_percent")


def current_deals(history: DataFrame, competitors: DataFrame, keys: Sequence[str] = KEYS,
                  ts: str = "captured_at", tie: Sequence[str] = ("id",)) -> DataFrame:
    """Products whose newest capture is on sale."""
    on_sale = latest_per_key(history, keys, ts, *tie).filter("is_on_sale")
    names = competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"))
    return on_sale.join(names, "competitor_id").select(
        "competitor_name", "product_name", "price", "original_price", "discount_percent",
        F.col("product_url").alias("url"))


def recent_price_alerts(alerts: DataFrame, competitors: DataFrame, n: int = 20,
                        tie: Sequence[str] = ()) -> DataFrame:
    """Newest alerts with the competitor's name."""
    names = competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"))
    order = [F.col("created_at").desc(), *[F.col(c).desc() for c in tie]]
    return alerts.join(names, "competitor_id").orderBy(*order).limit(n)


def price_overview(latest: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Products, on-sale count, mean price and rounded on-sale percent."""
    n, on_sale = F.count(F.lit(1)), F.count_if(F.col("is_on_sale"))
    return latest.groupBy(*by).agg(
        n.alias("products"), on_sale.alias("on_sale"),
        F.try_divide(F.sum("price").cast("double"), n).alias("mean_price"),
        F.floor(F.coalesce(F.try_divide(on_sale * 100.0, n), F.lit(0.0)) + 0.5).alias("discount_rate"),
    )

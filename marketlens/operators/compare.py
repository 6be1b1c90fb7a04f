"""Comparison of competitors by their newest analyses, ranks and trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.times import before
from marketlens.plans.skew import latest_per_key, top_n_per_key, with_position

# Compared metrics with their names, weights and short chart labels.
METRICS = [
    ("overall_score", "Overall Score", 1.0),
    ("title_score", "Title Optimization", 0.8),
    ("meta_description_score", "Meta Description", 0.7),
    ("headers_score", "Header Structure", 0.6),
    ("content_score", "Content Quality", 0.9),
    ("technical_score", "Technical SEO", 0.9),
    ("images_score", "Image Optimization", 0.5),
    ("links_score", "Link Profile", 0.6),
]
RADAR_LABELS = [
    ("overall_score", "Overall"), ("title_score", "Title"), ("meta_description_score", "Meta"),
    ("headers_score", "Headers"), ("content_score", "Content"), ("technical_score", "Technical"),
    ("links_score", "Links"), ("images_score", "Images"),
]


def latest_analyses(analyses: DataFrame) -> DataFrame:
    """Newest analysis of every competitor."""
    return latest_per_key(analyses, ["competitor_id"], "analyzed_at", "id")


def seo_history(analyses: DataFrame, n: int = 30) -> DataFrame:
    """The newest ``n`` analyses of every competitor."""
    return top_n_per_key(analyses, ["competitor_id"], [F.col("analyzed_at").desc(), F.col("id").desc()], n)


def _named(latest: DataFrame, competitors: DataFrame) -> DataFrame:
    names = competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"))
    return latest.join(names, "competitor_id")


def compare_scores(analyses: DataFrame, competitors: DataFrame, ids: list | None = None) -> DataFrame:
    """Side by side scores of the newest analyses, for some competitors or all."""
    chosen = analyses if ids is None else analyses.filter(F.col("competitor_id").isin(ids))
    return _named(latest_analyses(chosen), competitors).select(
        "competitor_id", "competitor_name", "overall_score", "title_score", "content_score", "technical_score",
        F.col("page_speed_score").alias("performance_score"))


def comparison_set(analyses: DataFrame, competitors: DataFrame, ids: list | None = None) -> DataFrame:
    """Newest metric values with names; missing values count as 0."""
    chosen = analyses if ids is None else analyses.filter(F.col("competitor_id").isin(ids))
    named = _named(latest_analyses(chosen), competitors)
    return named.select("competitor_id", "competitor_name", *[
        F.coalesce(F.col(key), F.lit(0)).alias(key) for key, _, _ in METRICS])


def metric_values(compared: DataFrame) -> DataFrame:
    """One row per competitor and metric."""
    return compared.unpivot(["competitor_id", "competitor_name"], [key for key, _, _ in METRICS], "key", "value")


def _metric_names() -> tuple[Column, Column]:
    name, order = F, F
    for i, (key, label, _) in enumerate(METRICS):
        name, order = name.when(F.col("key") == key, label), order.when(F.col("key") == key, i)
    return name.otherwise(None), order.otherwise(None)


def metric_comparison(compared: DataFrame, you=None) -> DataFrame:
    """Per metric: mean, best value and its holder, your value and rank, how many were compared.

    Values are counted per metric and score first, at most 101 rows a metric, and
    all statistics come from those counts. Equal values share a rank; of several
    best ones the smallest id is named.
    """
    mine = (F.col("competitor_id") == F.lit(you)) if you is not None else F.lit(False)
    counts = metric_values(compared).groupBy("key", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("competitor_id", "competitor_name")).alias("holder"),
        F.max(mine).alias("mine"))
    ranked = counts.withColumn("_above", F.coalesce(F.sum("n").over(
        Window.partitionBy("key").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)))
    name, order = _metric_names()
    n = F.sum("n")
    return ranked.groupBy("key").agg(
        F.max(F.when(F.col("mine"), F.col("value"))).alias("your_value"),
        F.bround(F.sum(F.col("value") * F.col("n")) / n, 1).alias("average"),
        F.max("value").alias("best_value"), F.max_by("holder.competitor_name", "value").alias("best_competitor"),
        F.coalesce(F.max(F.when(F.col("mine"), F.col("_above") + 1)), F.lit(0)).alias("your_rank"),
        n.alias("total"),
    ).withColumns({"metric": name, "metric_order": order})


def weighted_ranking(compared: DataFrame, you=None) -> DataFrame:
    """Weighted mean of the metrics (one decimal) with positions 1..n; ties go by id."""
    weighted = reduce(lambda a, b: a + b, [F.col(key) * F.lit(w) for key, _, w in METRICS], F.lit(0.0))
    weights = reduce(lambda a, b: a + b, [w for _, _, w in METRICS])
    scored = compared.select(
        "competitor_id", "competitor_name", F.bround(weighted / F.lit(weights), 1).alias("score"),
        ((F.col("competitor_id") == F.lit(you)) if you is not None else F.lit(False)).alias("is_you"))
    return with_position(scored, [F.col("score").desc(), F.col("competitor_id")], "rank")


def competitive_insights(metrics: DataFrame, ranking: DataFrame, you=None, n: int = 10) -> DataFrame:
    """Messages on your place and each metric, urgent ones first."""
    if you is None:
        return metrics.sparkSession.createDataFrame(
            [(0, "info", None, "Add your website to get personalized insights", None)],
            "pos int, type string, key string, message string, priority string")
    rank, score = F.col("rank"), F.col("score").cast("string")
    place = F.concat(F.lit("You're ranked #"), rank.cast("string"))
    overall = ranking.filter("is_you").select(
        F.lit(-1).alias("metric_order"), F.lit(None).cast("string").alias("key"),
        F.when(rank == 1, "success").when(rank <= 3, "info").otherwise("warning").alias("type"),
        F.when(rank == 1, F.concat(F.lit("You're leading in overall SEO with a score of "), score))
        .when(rank <= 3, F.concat(place, F.lit(" in SEO performance")))
        .otherwise(F.concat(place, F.lit(" - significant room for improvement"))).alias("message"),
        F.lit(None).cast("string").alias("priority"))
    value, mean, best = F.col("your_value"), F.col("average"), F.col("best_value")
    far = value < mean * 0.8
    rows = metrics.filter(value.isNotNull() & ((value >= best) | (value < mean))).select(
        "metric_order", "key",
        F.when(value >= best, "success").when(far, "danger").otherwise("warning").alias("type"),
        F.when(value >= best, F.concat(F.lit("Leading in "), "metric", F.lit(" ("), value.cast("string"), F.lit(")")))
        .when(far, F.concat("metric", F.lit(" is "), F.bround(mean - value, 1).cast("string"),
                            F.lit(" points below average")))
        .otherwise(F.concat("metric", F.lit(" slightly below average"))).alias("message"),
        F.when((value < best) & far, "high").alias("priority"))
    # At most one row per metric and one for the overall place.
    order = Window.orderBy(F.when(F.col("priority") == "high", 0).otherwise(1), "metric_order")
    return (
        overall.unionByName(rows).withColumn("pos", F.row_number().over(order) - 1)
        .filter(F.col("pos") < n).drop("metric_order")
    )


def radar_matrix(compared: DataFrame, you=None) -> DataFrame:
    """Chart values: one row per competitor, one column per metric."""
    mine = (F.col("competitor_id") == F.lit(you)) if you is not None else F.lit(False)
    return compared.select(
        F.col("competitor_name").alias("label"), *[F.col(key).alias(name) for key, name in RADAR_LABELS],
        mine.alias("is_you"))


def radar_by_metric(compared: DataFrame, names: list[str]) -> DataFrame:
    """The same turned: one row per metric, one column per named competitor."""
    label = F
    for key, name in RADAR_LABELS:
        label = label.when(F.col("key") == key, name)
    rows = metric_values(compared.filter(F.col("competitor_name").isin(names)))
    return rows.withColumn("metric", label.otherwise(None)).groupBy("metric").pivot("competitor_name", names).agg(
        F.max("value"))


def score_points(analyses: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Scores of the last ``days`` days; sort by time within a competitor for its series."""
    recent = analyses.filter(F.col("analyzed_at") >= before(analyses, "analyzed_at", as_of, days=days))
    zero = F.lit(0)
    return recent.select(
        "competitor_id", "id", "analyzed_at", "overall_score", F.coalesce("technical_score", zero)
        .alias("technical_score"), F.coalesce("content_score", zero).alias("content_score"))


def score_trend(analyses: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Direction of the overall score in the window: more than five points up or down."""
    recent = analyses.filter(F.col("analyzed_at") >= before(analyses, "analyzed_at", as_of, days=days))
    at = F.struct("analyzed_at", "id")
    folded = recent.groupBy("competitor_id").agg(
        F.count(F.lit(1)).alias("points"), F.min_by("overall_score", at).alias("first_score"),
        F.max_by("overall_score", at).alias("last_score"))
    change = F.col("last_score") - F.col("first_score")
    return folded.withColumns({
        "change": F.when(F.col("points") >= 2, change).otherwise(0),
        "trend": F.when(F.col("points") < 2, "neutral").when(change > 5, "improving")
        .when(change < -5, "declining").otherwise("stable")})


def daily_scores(analyses: DataFrame) -> DataFrame:
    """One row per competitor and day: first and last score with their time and id, number of points, their sum.

    Summaries of the same day merge, so those of late or further analyses are simply
    appended to the ones that are stored.
    """
    at = F.struct("analyzed_at", "id", F.col("overall_score").alias("score"))
    return analyses.filter("analyzed_at IS NOT NULL").groupBy("competitor_id", F.to_date("analyzed_at").alias("day")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("points"),
        F.sum(F.col("overall_score").cast("long")).alias("total"))


def rolling_trend(daily: DataFrame, edge: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """``score_trend`` with the mean score, from daily summaries instead of the series.

    Whole days of the window come from ``daily``. Of the analyses themselves only those
    of the day in which the window begins are read, from ``edge``; a table laid out by
    day reads just that day. Any number of summaries of one day will do.
    """
    start = before(edge, "analyzed_at", as_of, days=days)
    first_day = F.to_date(F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    begun = daily_scores(edge.filter((F.to_date("analyzed_at") == first_day) & (F.col("analyzed_at") >= start)))
    folded = daily.filter(F.col("day") > first_day).unionByName(begun).groupBy("competitor_id").agg(
        F.sum("points").alias("points"), F.min("first").alias("_first"), F.max("last").alias("_last"),
        F.sum("total").alias("_total"))
    change = F.col("_last.score") - F.col("_first.score")
    return folded.select(
        "competitor_id", "points", F.col("_first.score").alias("first_score"), F.col("_last.score").alias("last_score"),
        (F.col("_total") / F.col("points")).alias("mean_score"),
        F.when(F.col("points") >= 2, change).otherwise(0).alias("change"),
        F.when(F.col("points") < 2, "neutral").when(change > 5, "improving").when(change < -5, "declining")
        .otherwise("stable").alias("trend"))


def market_positioning(competitors: DataFrame, ids: list | None = None) -> DataFrame:
    """Chart points: seo strength, content quality and health; active competitors or the given ones."""
    chosen = competitors.filter("is_active") if ids is None else competitors.filter(F.col("id").isin(ids))
    return chosen.select("name", F.col("seo_score").alias("x"), F.col("content_score").alias("y"),
                         F.col("health_score").alias("size"), F.col("competitor_type").alias("type"))

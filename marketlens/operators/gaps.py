"""Coverage gaps between competitors: features, topics and keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import text as tx
from marketlens.functions.arrays import unnest
from marketlens.operators.compare import seo_history
from marketlens.plans.components import written
from marketlens.sources.tables import read_keywords_json


def _title_case(text: Column) -> Column:
    """Every run of letters starts with a capital."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def _chosen(df: DataFrame, ids: list | None) -> DataFrame:
    return df if ids is None else df.filter(F.col("competitor_id").isin(ids))


def _others(competitors: DataFrame, you, ids: list | None) -> Column:
    """Number of competitors other than yours, as a scalar subquery."""
    rows = competitors if ids is None else competitors.filter(F.col("id").isin(ids))
    if you is not None:
        rows = rows.filter(F.col("id") != F.lit(you))
    return rows.agg(F.count(F.lit(1))).scalar()


def _coverage(rows: DataFrame, item: str, you) -> DataFrame:
    """Per item: mentions, how many others have it, and whether you do.

    Rows are folded per (item, competitor) map-side first, so an item everybody
    has costs one row per competitor, not one per mention.
    """
    mine = (F.col("competitor_id") == F.lit(you)) if you is not None else F.lit(False)
    return rows.groupBy(item, "competitor_id").agg(F.sum("mentions").alias("mentions")).groupBy(item).agg(
        F.sum("mentions").alias("mentions"), F.count_if(~mine).alias("competitors_with"), F.max(mine).alias("yours"))


def _score(having: Column, others: Column) -> Column:
    return F.coalesce((F.try_divide(having, others) * 100).cast("int"), F.lit(0))


def _first(ordered: DataFrame, n: int | None) -> DataFrame:
    return ordered if n is None else ordered.limit(n)


def _owned(features: DataFrame, ids: list | None) -> DataFrame:
    return _chosen(features, ids).select(
        F.lower(F.trim("feature_name")).alias("feature"), "competitor_id", F.lit(1).alias("mentions"))


def _missing_features(features: DataFrame, competitors: DataFrame, you, ids: list | None, min_score: int) -> DataFrame:
    covered = _coverage(_owned(features, ids), "feature", you).filter(~F.col("yours"))
    scored = covered.withColumn("competitors_total", _others(competitors, you, ids)).withColumn(
        "opportunity_score", _score(F.col("competitors_with"), F.col("competitors_total")))
    return scored.filter(F.col("opportunity_score") >= min_score)


def feature_gaps(features: DataFrame, competitors: DataFrame, you=None, ids: list | None = None,
                 min_score: int = 20, n: int | None = None) -> DataFrame:
    """Features most others have and you lack, best opportunities first, all or the first ``n``.

    ``features`` carries competitor_id. Names are compared trimmed and lower-cased.
    """
    best = _first(_missing_features(features, competitors, you, ids, min_score).orderBy(
        F.col("opportunity_score").desc(), F.col("mentions").desc(), "feature"), n)
    return best.select(
        _title_case(F.col("feature")).alias("feature_name"), F.lit("Missing").alias("your_status"),
        "competitors_with", "competitors_total", "opportunity_score")


def feature_gap_coverage(features: DataFrame, competitors: DataFrame, you=None, ids: list | None = None,
                         min_score: int = 20) -> DataFrame:
    """(feature_name, competitor_id): who has each missing feature."""
    missing = _missing_features(features, competitors, you, ids, min_score).select("feature")
    return _owned(features, ids).select("feature", "competitor_id").distinct().join(missing, "feature").select(
        _title_case(F.col("feature")).alias("feature_name"), "competitor_id")


def feature_matrix(features: DataFrame, products: DataFrame, competitors: DataFrame, names: list[str],
                   ids: list | None = None) -> DataFrame:
    """Feature values per competitor over products with exactly these names."""
    named = _chosen(products, ids).filter(F.col("name").isin(names)).select(
        F.col("id").alias("product_id"), "competitor_id")
    return _matrix(features.drop("competitor_id").join(named, "product_id"), competitors, F.col("feature_value"))


def feature_matrix_like(features: DataFrame, products: DataFrame, competitors: DataFrame, texts: list[str],
                        ids: list | None = None) -> DataFrame:
    """The same over one product per competitor and text whose name contains the text.

    Of several such products the smallest id is read. A feature without a value
    shows a tick.
    """
    low = F.lower("name")
    hits = _chosen(products, ids).select(
        "competitor_id", "id", F.explode(F.filter(
            F.array(*[F.lit(t) for t in texts]), lambda t: F.contains(low, F.lower(t)))).alias("text"))
    chosen = hits.groupBy("competitor_id", "text").agg(F.min("id").alias("product_id")).select(
        "competitor_id", "product_id").distinct()
    rows = features.drop("competitor_id").join(chosen, "product_id")
    return _matrix(rows, competitors, F.coalesce(F.nullif("feature_value", F.lit("")), F.lit("✓")))


def _matrix(rows: DataFrame, competitors: DataFrame, value: Column) -> DataFrame:
    """One value per feature and competitor, the one of the largest product id."""
    names = competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"))
    cells = rows.withColumn("_value", value).groupBy("feature_name", "competitor_id").agg(
        F.max(F.struct("product_id", "_value"))["_value"].alias("value"))
    return cells.join(names, "competitor_id").select("feature_name", "competitor_name", "value")


def feature_presence(features: DataFrame, competitors: DataFrame, category: str | None = None,
                     n: int | None = None) -> DataFrame:
    """Matrix over all competitors for all features, or the first ``n`` by name."""
    kept = features if category is None else features.filter(F.col("feature_category") == category)
    if n is not None:
        # The list holds n names at most.
        kept = kept.join(F.broadcast(kept.select("feature_name").distinct().orderBy("feature_name").limit(n)), "feature_name")
    return _matrix(kept, competitors, F.coalesce(F.nullif("feature_value", F.lit("")), F.lit("Present")))


def _topics(contents: DataFrame, n: int | None = None) -> DataFrame:
    return read_keywords_json(contents.select("competitor_id", "keywords"), "keywords", "topic", n)


def _topic_users(contents: DataFrame, ids: list | None, per_page: int | None) -> DataFrame:
    """(topic, competitor_id, mentions): topics as keywords, and title words where they are some page's topic.

    Folded per topic and competitor map-side, so a frequent topic is one row per
    competitor, not one per page. Title words count as coverage, not as mentions.
    """
    own = _chosen(contents, ids)
    named = _topics(own, per_page).select(F.lower("topic").alias("topic"), "competitor_id", F.lit(1).alias("mentions"))
    titled = unnest(own, ["competitor_id"], F.array_distinct(F.filter(
        tx.words(F.lower("title")), lambda w: F.length(w) > 4)), "topic").select(
        "topic", "competitor_id", F.lit(0).alias("mentions"))
    return named.unionByName(titled).groupBy("topic", "competitor_id").agg(F.sum("mentions").alias("mentions"))


def _missing_topics(users: DataFrame, competitors: DataFrame, you, ids: list | None) -> DataFrame:
    mine = (F.col("competitor_id") == F.lit(you)) if you is not None else F.lit(False)
    covered = users.groupBy("topic").agg(
        F.sum("mentions").alias("mentions"), F.count_if(~mine).alias("competitors_with"), F.max(mine).alias("yours"))
    return (
        covered.filter((F.col("mentions") > 0) & ~F.col("yours") & (F.col("competitors_with") >= 2))
        .withColumn("competitors_total", _others(competitors, you, ids))
        .withColumn("opportunity_score", _score(F.col("competitors_with"), F.col("competitors_total")))
    )


def content_gaps(contents: DataFrame, competitors: DataFrame, you=None, ids: list | None = None,
                 n: int | None = None, top_topics: int | None = None, per_page: int | None = None) -> DataFrame:
    """Topics two or more others cover and you do not, best opportunities first, all or the first ``n``.

    Topics are all keywords of each page, or the first ``per_page``. Longer title
    words add to coverage but not to the ranking of topics. With ``top_topics`` only
    that many missing topics, the most mentioned, are ranked.
    """
    missing = _missing_topics(_topic_users(contents, ids, per_page), competitors, you, ids)
    if top_topics is not None:
        missing = missing.orderBy(F.col("mentions").desc(), "topic").limit(top_topics)
    return _first(missing.orderBy(F.col("opportunity_score").desc(), F.col("mentions").desc(), "topic"), n).select(
        _title_case(F.col("topic")).alias("topic"), F.lit(False).alias("your_coverage"),
        "competitors_with", "competitors_total", "opportunity_score")


def content_gap_coverage(contents: DataFrame, competitors: DataFrame, you=None, ids: list | None = None,
                         per_page: int | None = None) -> DataFrame:
    """(topic, competitor_id): who covers each missing topic."""
    # Written once: texts are read and their topics counted for the missing ones and for those who cover them.
    users = written(_topic_users(contents, ids, per_page), "topic-users")
    missing = _missing_topics(users, competitors, you, ids).select("topic")
    return users.join(missing, "topic").select(_title_case(F.col("topic")).alias("topic"), "competitor_id")


def _partly_covered(pairs: DataFrame, competitors: DataFrame, ids: list | None) -> DataFrame:
    counted = pairs.groupBy("topic").agg(F.count(F.lit(1)).alias("competitors_with"))
    return counted.withColumn("competitors_total", _others(competitors, None, ids)).filter(
        F.col("competitors_with") < F.col("competitors_total"))


def topic_coverage(contents: DataFrame, competitors: DataFrame, ids: list | None = None,
                   per_page: int | None = None) -> DataFrame:
    """Topics covered by some competitors but not by all."""
    pairs = _topics(_chosen(contents, ids), per_page).select("topic", "competitor_id").distinct()
    return _partly_covered(pairs, competitors, ids)


def topic_coverage_rows(contents: DataFrame, competitors: DataFrame, ids: list | None = None,
                        per_page: int | None = None) -> DataFrame:
    """(topic, competitor_id): who covers each topic that not all cover."""
    pairs = _topics(_chosen(contents, ids), per_page).select("topic", "competitor_id").distinct()
    return pairs.join(_partly_covered(pairs, competitors, ids).select("topic"), "topic")


def topic_matrix(contents: DataFrame, competitors: DataFrame, content_type: str | None = None,
                 n: int | None = None, per_page: int | None = None) -> DataFrame:
    """(topic, competitor) pairs covered, for all topics or the first ``n`` by name."""
    kept = contents if content_type is None else contents.filter(F.col("content_type") == content_type)
    pairs = _topics(kept, per_page).select("topic", "competitor_id").distinct()
    if n is not None:
        # The list holds n topics at most.
        pairs = pairs.join(F.broadcast(pairs.select("topic").distinct().orderBy("topic").limit(n)), "topic")
    names = competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"))
    return pairs.join(names, "competitor_id").select("topic", "competitor_name")


def keyword_opportunities(analyses: DataFrame, competitors: DataFrame, ids: list | None = None,
                          n: int | None = None, newest_of_each: int | None = None,
                          per_analysis: int | None = None) -> DataFrame:
    """Keywords few competitors use, all or the first ``n``, of all analyses or the newest of each competitor.

    ``per_analysis`` reads so many keywords of an analysis. 100 less 15 per competitor,
    10 at least.
    """
    own = _chosen(analyses, ids)
    newest = (own if newest_of_each is None else seo_history(own, newest_of_each)).join(
        competitors.select(F.col("id").alias("competitor_id")), "competitor_id", "left_semi")
    words = read_keywords_json(
        newest.filter(F.col("keyword_density").rlike(r"^\s*\{")).select("competitor_id", "keyword_density"),
        "keyword_density", n=per_analysis)
    users = words.select(F.lower("keyword").alias("keyword"), "competitor_id").filter(
        F.length("keyword") > 3).distinct()
    scored = users.groupBy("keyword").agg(F.count(F.lit(1)).alias("competitors_ranking")).withColumn(
        "opportunity_score", F.greatest(F.lit(100) - F.col("competitors_ranking") * 15, F.lit(10)).cast("int"))
    return scored if n is None else scored.orderBy(F.col("opportunity_score").desc(), "keyword").limit(n)


def keyword_opportunities_recent(analyses: DataFrame, competitors: DataFrame, limit: int | None = None,
                                 window: int | None = None) -> DataFrame:
    """Keywords of all analyses or the newest ``window``; all of them, or the first ``limit`` seen.

    100 less 10 per occurrence, 20 at least.
    """
    known = analyses.join(competitors.select(F.col("id").alias("competitor_id")), "competitor_id", "left_semi")
    newest = known.select("id", "analyzed_at", "keyword_density")
    if window is not None:
        newest = newest.orderBy(F.col("analyzed_at").desc(), F.col("id").desc()).limit(window)
    words = read_keywords_json(newest.filter(F.col("keyword_density").rlike(r"^\s*\{")), "keyword_density")
    seen = F.max(F.struct("analyzed_at", "id", (-F.col("keyword_pos")).alias("back")))
    first = words.groupBy("keyword").agg(F.count(F.lit(1)).alias("occurrences"), seen.alias("seen"))
    if limit is not None:
        first = first.orderBy(F.col("seen").desc(), "keyword").limit(limit)
    return first.select("keyword", "occurrences", F.greatest(
        F.lit(100) - F.col("occurrences") * 10, F.lit(20)).cast("int").alias("opportunity_score"))


def gap_summary(feature: DataFrame, content: DataFrame, keyword: DataFrame) -> DataFrame:
    """Sizes of the three gap lists and an overall score: 100 less two per gap, never below 0."""
    parts = {"feature_gaps": feature, "content_gaps": content, "keyword_opportunities": keyword}
    counts = reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n") for name, df in parts.items()])
    summed = counts.agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in parts],
                        F.sum("n").alias("_total"))
    return summed.withColumn("overall_opportunity_score", F.greatest(
        F.lit(0), F.lit(100) - F.col("_total") * 2)).drop("_total")

"""Score columns: each is a whole number from 0 to 100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands (low, high, score) tried from the narrowest on.
TITLE_BANDS = [(50, 60, 100), (40, 70, 80), (30, 80, 60)]
META_BANDS = [(150, 160, 100), (120, 180, 80), (80, 200, 60)]
# Least words and score.
CONTENT_STEPS = [(2000, 100), (1500, 90), (1000, 80), (500, 60), (300, 40)]
REPORT_WORD_STEPS = [(2000, 100), (1000, 80), (500, 60), (300, 40)]
# Weights of the page score, and of the comparison ranking.
OVERALL_WEIGHTS = [("title_score", 0.15), ("meta_description_score", 0.10), ("headers_score", 0.10),
                   ("content_score", 0.20), ("technical_score", 0.25), ("links_score", 0.10),
                   ("images_score", 0.10)]
# Schema types that count extra.
PRIORITY_SCHEMAS = ["Organization", "LocalBusiness", "Product", "Article", "BlogPosting", "BreadcrumbList",
                    "FAQPage", "HowTo", "Review", "Recipe", "Event", "Person", "WebSite", "WebPage"]
# Tags a shared page should carry.
REQUIRED_OPEN_GRAPH = ["og:image", "og:title", "og:type", "og:url"]
RECOMMENDED_OPEN_GRAPH = ["og:description", "og:site_name", "og:locale"]


def _banded(length: Column, bands: list[tuple[int, int, int]]) -> Column:
    chain = F
    for low, high, score in bands:
        chain = chain.when(length.between(low, high), score)
    return chain.when(length > 0, 40).otherwise(0)


def _stepped(value: Column, steps: list[tuple[int, int]], least: int) -> Column:
    chain = F
    for bound, score in steps:
        chain = chain.when(value >= bound, score)
    return chain.otherwise(least)


def title_score(length: Column) -> Column:
    return _banded(length, TITLE_BANDS)


def meta_description_score(length: Column) -> Column:
    return _banded(length, META_BANDS)


def headers_score(h1: Column, h2: Column, h3: Column) -> Column:
    return (
        F.when(h1 == 1, 50).when(h1 > 1, 25).otherwise(0)
        + F.when(h2 >= 2, 30).when(h2 > 0, 15).otherwise(0)
        + F.when(h3 >= 2, 20).when(h3 > 0, 10).otherwise(0))


def technical_score(ssl: Column, canonical: Column, schema: Column, sitemap: Column, robots: Column) -> Column:
    parts = [(ssl, 30), (canonical, 20), (schema, 20), (sitemap, 15), (robots, 15)]
    total = F.lit(0)
    for flag, points in parts:
        total = total + F.when(flag, points).otherwise(0)
    return total


def content_score(words: Column) -> Column:
    return _stepped(words, CONTENT_STEPS, 20)


def report_word_score(words: Column) -> Column:
    return _stepped(words, REPORT_WORD_STEPS, 20)


def links_score(internal: Column, external: Column) -> Column:
    return (F.lit(50) + F.when(internal >= 5, 25).otherwise(0)
            + F.when(external.between(3, 10), 25).when(external > 0, 15).otherwise(0))


def images_score(total: Column, with_alt: Column) -> Column:
    return F.when(total == 0, 100).otherwise(F.try_divide(with_alt, total) * 100).cast("int")


def overall_score() -> Column:
    """Weighted sum of the seven component columns, truncated."""
    total = F.lit(0.0)
    for name, weight in OVERALL_WEIGHTS:
        total = total + F.col(name) * F.lit(weight)
    return total.cast("int")


def schema_score(items: Column) -> Column:
    """From an array of items with ``type`` and ``is_valid``."""
    valid = F.size(F.filter(items, lambda i: i["is_valid"]))
    priority = F.size(F.filter(items, lambda i: i["type"].isin(PRIORITY_SCHEMAS)))
    kinds = F.size(F.array_distinct(F.transform(items, lambda i: i["type"])))
    score = (F.lit(20) + F.least(valid * 10, F.lit(30)) + F.least(priority * 15, F.lit(30))
             + F.when(kinds >= 3, 20).when(kinds == 2, 10).otherwise(0))
    return F.when(F.size(items) == 0, 0).otherwise(F.least(score, F.lit(100)))


def has_priority_schema(items: Column) -> Column:
    return F.exists(items, lambda i: i["type"].isin(PRIORITY_SCHEMAS))


def _names(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def open_graph_score(tags: Column) -> Column:
    present = F.map_keys(tags)
    sized = F.size(F.array_intersect(present, _names("og:image", "og:image:width", "og:image:height"))) == 3
    score = (F.lit(20) + F.size(F.array_intersect(present, _names(*REQUIRED_OPEN_GRAPH))) * 15
             + F.size(F.array_intersect(present, _names(*RECOMMENDED_OPEN_GRAPH))) * 5
             + F.when(sized, 10).otherwise(0))
    return F.when(F.size(present) == 0, 0).otherwise(F.least(score, F.lit(100)))


def missing_open_graph(tags: Column) -> Column:
    """Required tags the page lacks, by name."""
    return F.array_except(_names(*REQUIRED_OPEN_GRAPH), F.map_keys(tags))


def twitter_score(tags: Column) -> Column:
    card = F.coalesce(tags["twitter:card"], F.lit(""))
    score = F.lit(20) + F.when(card == "summary_large_image", 30).when(card == "summary", 20).when(
        card != "", 10).otherwise(0)
    for name, points in (("twitter:title", 15), ("twitter:description", 15), ("twitter:image", 20)):
        score = score + F.when(F.map_contains_key(tags, name), points).otherwise(0)
    return F.when(F.size(tags) == 0, 0).otherwise(F.least(score, F.lit(100)))


def social_score(open_graph: Column, twitter: Column) -> Column:
    return F.floor((open_graph + twitter) / 2).cast("int")


def estimated_fcp_ms(size: Column, scripts: Column, stylesheets: Column) -> Column:
    steps = F.floor(size / 10000)
    return F.least(F.lit(800) + steps * 100 + scripts * 50 + stylesheets * 30, F.lit(5000)).cast("int")


def estimated_lcp_ms(size: Column, images: Column, any_lazy: Column) -> Column:
    steps = F.floor(size / 10000)
    per_image = F.when(any_lazy, 20).otherwise(50)
    return F.least(F.lit(1200) + steps * 150 + images * per_image, F.lit(8000)).cast("int")


def page_speed_score(size: Column, scripts: Column, stylesheets: Column, deferred: Column, preload: Column,
                     preconnect: Column) -> Column:
    weight = F.when(size > 500_000, 30).when(size > 200_000, 15).when(size > 100_000, 5).otherwise(0)
    score = (F.lit(100) - weight - F.least(scripts * 2, F.lit(20)) - F.least(stylesheets * 3, F.lit(15))
             + F.when(deferred, 10).otherwise(0) + F.when(preload, 5).otherwise(0)
             + F.when(preconnect, 5).otherwise(0))
    return F.greatest(F.lit(0), F.least(score, F.lit(100)))


def score_status(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 50, "warning").otherwise("error")


def score_label(score: Column) -> Column:
    return (F.when(score >= 90, "Excellent").when(score >= 80, "Great").when(score >= 70, "Good")
            .when(score >= 60, "Fair").when(score >= 50, "Needs Work").otherwise("Poor"))


def health_score(seo: Column, content: Column) -> Column:
    """Activity counts as 70 until it is measured."""
    zero = F.lit(0)
    return (F.coalesce(seo, zero) * F.lit(0.4) + F.coalesce(content, zero) * F.lit(0.3)
            + F.lit(70) * F.lit(0.3)).cast("int")

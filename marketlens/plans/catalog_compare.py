"""Queries: scores, reports, comparison, trends and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import scores as sc
from marketlens.functions.arrays import unnest
from marketlens.operators import compare as co
from marketlens.operators import gaps as ga
from marketlens.operators import seo
from marketlens.operators import seo_reports as sr
from marketlens.plans import entity_views as ev
from marketlens.plans.components import written
from marketlens.plans.registry import query

YOU = 7
KEYS = [key for key, _, _ in co.METRICS]


def _analyses(spark, sf):
    return ev.seo_analyses(spark, sf)


def _bands(length: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {length} BETWEEN {a} AND {b} THEN {s}" for a, b, s in bands) + (
        f" WHEN {length} > 0 THEN 40 ELSE 0 END")


def _steps(value: str, steps, least: int) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {a} THEN {s}" for a, s in steps) + f" ELSE {least} END"


def _status(score: str) -> str:
    return f"CASE WHEN {score} >= 80 THEN 'good' WHEN {score} >= 50 THEN 'warning' ELSE 'error' END"


# --- score columns over stored analyses -------------------------------------------------------


@query("score_columns", f"""
SELECT id, {_bands('title_length', sc.TITLE_BANDS)} AS title_score,
  {_bands('meta_description_length', sc.META_BANDS)} AS meta_description_score,
  CASE WHEN h1_count = 1 THEN 50 WHEN h1_count > 1 THEN 25 ELSE 0 END + CASE WHEN h2_count >= 2 THEN 30
    WHEN h2_count > 0 THEN 15 ELSE 0 END + CASE WHEN h3_count >= 2 THEN 20 WHEN h3_count > 0 THEN 10 ELSE 0 END
    AS headers_score,
  CASE WHEN has_ssl THEN 30 ELSE 0 END + CASE WHEN has_canonical THEN 20 ELSE 0 END + CASE WHEN has_schema THEN 20 ELSE 0 END
    + CASE WHEN has_sitemap THEN 15 ELSE 0 END + CASE WHEN has_robots THEN 15 ELSE 0 END AS technical_score,
  {_steps('word_count', sc.CONTENT_STEPS, 20)} AS content_score,
  50 + CASE WHEN internal_links >= 5 THEN 25 ELSE 0 END + CASE WHEN external_links BETWEEN 3 AND 10 THEN 25
    WHEN external_links > 0 THEN 15 ELSE 0 END AS links_score,
  CASE WHEN images_count = 0 THEN 100 ELSE CAST(trunc(images_with_alt::DOUBLE / images_count * 100) AS INTEGER) END
    AS images_score,
  {_status('overall_score')} AS status,
  CASE WHEN overall_score >= 90 THEN 'Excellent' WHEN overall_score >= 80 THEN 'Great' WHEN overall_score >= 70
    THEN 'Good' WHEN overall_score >= 60 THEN 'Fair' WHEN overall_score >= 50 THEN 'Needs Work' ELSE 'Poor' END AS label
FROM seo_analyses""", "seo_analyses")
def _(spark, sf):
    c = F.col
    return _analyses(spark, sf).select(
        "id", sc.title_score(c("title_length")).alias("title_score"),
        sc.meta_description_score(c("meta_description_length")).alias("meta_description_score"),
        sc.headers_score(c("h1_count"), c("h2_count"), c("h3_count")).alias("headers_score"),
        sc.technical_score(c("has_ssl"), c("has_canonical"), c("has_schema"), c("has_sitemap"), c("has_robots"))
        .alias("technical_score"),
        sc.content_score(c("word_count")).alias("content_score"),
        sc.links_score(c("internal_links"), c("external_links")).alias("links_score"),
        sc.images_score(c("images_count"), c("images_with_alt")).alias("images_score"),
        sc.score_status(c("overall_score")).alias("status"), sc.score_label(c("overall_score")).alias("label"))


@query("overall_seo_score", "SELECT id, CAST(trunc(0.0::DOUBLE" + "".join(
    f" + {name} * {w}::DOUBLE" for name, w in sc.OVERALL_WEIGHTS) + ") AS INTEGER) AS overall_score FROM seo_analyses",
       "seo_analyses")
def _(spark, sf):
    return _analyses(spark, sf).select("id", sc.overall_score().alias("overall_score"))


@query("health_score", """
SELECT id, CAST(trunc(seo_score * 0.4::DOUBLE + content_score * 0.3::DOUBLE + 70 * 0.3::DOUBLE) AS INTEGER) AS health_score
FROM competitors""", "competitors")
def _(spark, sf):
    return ev.competitors(spark, sf).select(
        "id", sc.health_score(F.col("seo_score"), F.col("content_score")).alias("health_score"))


@query("recalculate_scores", """
WITH s AS (SELECT competitor_id, CAST(trunc(avg(overall_score)) AS INTEGER) AS seo FROM seo_analyses GROUP BY 1),
t AS (SELECT competitor_id, count(*) AS n, avg(readability_score) AS ease FROM contents GROUP BY 1),
n AS (SELECT c.id, coalesce(seo, 0) AS seo_score, CASE WHEN n > 0 AND ease <> 0
    THEN least(100, CAST(trunc((ease + n) / 2) AS INTEGER)) ELSE content_score END AS content_score
  FROM competitors c LEFT JOIN s ON s.competitor_id = c.id LEFT JOIN t ON t.competitor_id = c.id)
SELECT id, seo_score, content_score, CAST(trunc(seo_score * 0.4::DOUBLE + content_score * 0.3::DOUBLE
  + 70 * 0.3::DOUBLE) AS INTEGER) AS health_score FROM n""", "competitors seo_analyses contents")
def _(spark, sf):
    return seo.recalculate_scores(ev.competitors(spark, sf), _analyses(spark, sf), ev.contents(spark, sf)).select(
        "id", "seo_score", "content_score", "health_score")


_LATEST = """latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY competitor_id
  ORDER BY analyzed_at DESC, id DESC) AS rn FROM seo_analyses) WHERE rn = 1)"""

# --- reports ----------------------------------------------------------------------------------


def _sql_listed(*rows: tuple[str, str]) -> str:
    return "concat_ws(' | ', " + ", ".join(f"CASE WHEN {cond} THEN {text} END" for cond, text in rows) + ")"


def _sql_cards() -> str:
    t, m = "coalesce(title, '') <> ''", "coalesce(meta_description, '') <> ''"
    cards = [
        ("Title Tag", "title_score", [
            (f"NOT ({t})", "'Missing title tag'", "'Add a descriptive title tag'"),
            (f"{t} AND title_length < 30", "'Title too short'", "'Expand title to 50-60 characters'"),
            (f"{t} AND title_length > 60", "'Title too long'", "'Shorten title to under 60 characters'")]),
        ("Meta Description", "meta_description_score", [
            (f"NOT ({m})", "'Missing meta description'", "'Add a compelling meta description'"),
            (f"{m} AND meta_description_length < 120", "'Meta description too short'",
             "'Expand to 150-160 characters'")]),
        ("Headings", "headers_score", [
            ("h1_count = 0", "'No H1 heading found'", "'Add exactly one H1 heading'"),
            ("h1_count > 1", "'Multiple H1 headings (' || h1_count || ')'", "'Use only one H1 heading per page'")]),
        ("Images", "images_score", [
            ("images_count > images_with_alt", "(images_count - images_with_alt) || ' images missing alt text'",
             "'Add descriptive alt text to all images'")]),
        ("Technical SEO", "technical_score", [
            ("NOT has_ssl", "'No SSL certificate'", "'Enable HTTPS'"),
            ("NOT has_sitemap", "'Missing sitemap.xml'", "'Create and submit a sitemap'"),
            ("NOT has_robots", "'Missing robots.txt'", "'Add a robots.txt file'"),
            ("NOT has_canonical", "'Missing canonical tag'",
             "'Add canonical tags to prevent duplicate content'"),
            ("NOT has_schema", "'No schema markup detected'", "'Implement structured data'")]),
    ]
    return " UNION ALL ".join(
        f"SELECT competitor_id, {i} AS pos, '{name}' AS category, {score} AS score, 100 AS max_score, "
        f"{_sql_listed(*[(a, b) for a, b, _ in checks])} AS issues, "
        f"{_sql_listed(*[(a, b) for a, _, b in checks])} AS recommendations FROM latest"
        for i, (name, score, checks) in enumerate(cards))


@query("seo_audit_cards", f"WITH {_LATEST} {_sql_cards()}", "seo_analyses")
def _(spark, sf):
    return sr.seo_audit_cards(_analyses(spark, sf)).select(
        "competitor_id", "pos", "category", "score", "max_score",
        *[F.array_join(c, " | ").alias(c) for c in ("issues", "recommendations")])


def _sql_items() -> str:
    """Report items of the newest analyses: (competitor_id, section, sec, pos, name, score, value, advice)."""
    def flag(name, col, yes, no, advice):
        return (name, f"CASE WHEN {col} THEN 100 ELSE 0 END", f"CASE WHEN {col} THEN '{yes}' ELSE '{no}' END",
                f"CASE WHEN NOT {col} THEN '{advice}' END")

    sections = [
        ("On-Page SEO", [
            ("Page Title", "title_score",
             "CASE WHEN coalesce(title, '') = '' THEN 'Missing' ELSE '\"' || title || '\"' END",
             "CASE WHEN coalesce(title, '') = '' THEN 'Add a unique, descriptive page title' WHEN title_length < 30 "
             "THEN 'Title is too short - aim for 50-60 characters' WHEN title_length > 70 "
             "THEN 'Title is too long - it may be truncated in search results' END"),
            ("Meta Description", "meta_description_score", "meta_description_length || ' characters'",
             "CASE WHEN coalesce(meta_description, '') = '' THEN 'Add a meta description to improve click-through rates' "
             "WHEN meta_description_length < 120 THEN 'Meta description is too short - aim for 150-160 characters' "
             "WHEN meta_description_length > 170 THEN 'Meta description is too long - it may be truncated' END"),
            ("Header Structure", "headers_score",
             "'H1: ' || h1_count || ', H2: ' || h2_count || ', H3: ' || h3_count",
             "CASE WHEN h1_count = 0 THEN 'Add an H1 heading to the page' WHEN h1_count > 1 "
             "THEN 'Use only one H1 heading per page' WHEN h2_count = 0 "
             "THEN 'Add H2 subheadings to structure your content' END")]),
        ("Technical SEO", [
            flag("HTTPS/SSL", "has_ssl", "Enabled", "Not Enabled", "Enable HTTPS for security and SEO benefits"),
            flag("Sitemap", "has_sitemap", "Found", "Not Found", "Create and submit an XML sitemap"),
            flag("Robots.txt", "has_robots", "Found", "Not Found", "Create a robots.txt file"),
            flag("Canonical Tag", "has_canonical", "Present", "Missing",
                 "Add canonical tags to prevent duplicate content issues"),
            flag("Schema Markup", "has_schema", "Found", "Not Found", "Add structured data for rich snippets")]),
        ("Content", [
            ("Word Count", _steps("word_count", sc.REPORT_WORD_STEPS, 20), "word_count || ' words'",
             "CASE WHEN word_count < 300 THEN 'Content is too thin - aim for at least 500 words' WHEN word_count < 1000 "
             "THEN 'Consider expanding content for better rankings' END")]),
        ("Images", [
            ("Alt Text Coverage", "images_score",
             "images_with_alt || '/' || images_count || ' images have alt text'",
             "CASE WHEN images_count = 0 THEN NULL WHEN images_with_alt::DOUBLE / images_count < 0.5 "
             "THEN 'Add descriptive alt text to images for accessibility and SEO' WHEN images_with_alt < images_count "
             "THEN 'Some images are missing alt text' END")]),
        ("Links", [
            ("Internal Links", "least(100, internal_links * 10)", "internal_links || ' internal links'",
             "CASE WHEN internal_links < 5 THEN 'Add more internal links' END"),
            ("External Links", "least(100, external_links * 15)", "external_links || ' external links'",
             "CASE WHEN external_links < 2 THEN 'Add relevant external links' END")]),
    ]
    return " UNION ALL ".join(
        f"SELECT competitor_id, '{title}' AS section, {i} AS sec, {j} AS pos, '{name}' AS item, "
        f"CAST({score} AS INTEGER) AS score, {value} AS value, {advice} AS recommendation FROM latest"
        for i, (title, items) in enumerate(sections, 1) for j, (name, score, value, advice) in enumerate(items))


_ITEMS_SQL = f"{_LATEST}, items AS (SELECT i.* FROM ({_sql_items()}) i JOIN competitors c ON c.id = i.competitor_id)"


@query("seo_report", f"""
WITH {_ITEMS_SQL} SELECT competitor_id, section, pos, item, score, {_status('score')} AS status, value, recommendation
FROM items""", "seo_analyses competitors")
def _(spark, sf):
    report = sr.seo_report(_analyses(spark, sf), ev.competitors(spark, sf))
    return unnest(unnest(report, ["competitor_id"], "sections", "s"), [
        "competitor_id", F.col("s.title").alias("section")], "s.items", "i", "pos").select(
        "competitor_id", "section", "pos", F.col("i.name").alias("item"), "i.score", "i.status", "i.value",
        "i.recommendation")


@query("seo_report_sections", f"""
WITH {_LATEST}, l AS (SELECT l.* FROM latest l JOIN competitors c ON c.id = l.competitor_id), s AS (
  SELECT competitor_id, 'Overall Score' AS title, overall_score AS score FROM l
  UNION ALL SELECT competitor_id, 'On-Page SEO',
    CAST((title_score + meta_description_score + headers_score) // 3 AS INTEGER) FROM l
  UNION ALL SELECT competitor_id, 'Technical SEO', technical_score FROM l
  UNION ALL SELECT competitor_id, 'Content', content_score FROM l
  UNION ALL SELECT competitor_id, 'Images', images_score FROM l
  UNION ALL SELECT competitor_id, 'Links', links_score FROM l)
SELECT competitor_id, title, score, {_status('score')} AS status FROM s""", "seo_analyses competitors")
def _(spark, sf):
    report = sr.seo_report(_analyses(spark, sf), ev.competitors(spark, sf))
    return unnest(report, ["competitor_id"], "sections", "s").select(
        "competitor_id", "s.title", "s.score", "s.status")


@query("priority_fixes", f"""
WITH {_ITEMS_SQL}, f AS (SELECT *, CASE WHEN score < 50 THEN 'high' ELSE 'medium' END AS priority FROM items
  WHERE score < 80 AND recommendation IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY priority = 'medium', sec, pos) - 1 AS rn FROM f)
SELECT competitor_id, CAST(rn AS INTEGER) AS pos, section, item, recommendation, priority FROM r WHERE rn < 10""",
       "seo_analyses competitors")
def _(spark, sf):
    report = sr.seo_report(_analyses(spark, sf), ev.competitors(spark, sf))
    return unnest(report, ["competitor_id"], "priority_fixes", "f", "pos").select(
        "competitor_id", "pos", "f.section", "f.item", "f.recommendation", "f.priority")


_INSIGHTS = [
    ("title_score >= 80", "success", "'Title tag is well optimized'", 3),
    ("title_score < 60", "error", "'Title tag needs improvement - ensure it''s 50-60 characters'", 1),
    ("meta_description_score < 60", "error", "'Meta description is missing or too short'", 1),
    ("NOT has_ssl", "error", "'SSL certificate not detected - critical for security'", 1),
    ("NOT has_sitemap", "warning", "'Sitemap.xml not found - important for crawling'", 2),
    ("has_ssl AND has_sitemap AND has_robots", "success", "'Technical SEO fundamentals are solid'", 3),
    ("word_count < 300", "warning", "'Content is thin - aim for 1000+ words'", 2),
    ("word_count >= 1500", "success", "'Content length is excellent for SEO'", 3),
    ("h1_count = 0", "error", "'Missing H1 heading - every page needs one'", 1),
    ("h1_count > 1", "warning", "'Multiple H1 tags (' || h1_count || ') - use only one'", 2),
    ("images_count > images_with_alt", "warning", "(images_count - images_with_alt) || ' images missing alt text'", 2),
]


@query("page_insights", "WITH found AS (" + " UNION ALL ".join(
    f"SELECT id, competitor_id, {i} AS ord, '{kind}' AS type, {message} AS message, {priority} AS priority "
    f"FROM seo_analyses WHERE {cond}" for i, (cond, kind, message, priority) in enumerate(_INSIGHTS)) + """)
SELECT id, competitor_id, CAST(row_number() OVER (PARTITION BY id ORDER BY priority, ord) - 1 AS INTEGER) AS pos,
  type, message, priority FROM found""", "seo_analyses")
def _(spark, sf):
    return sr.page_insights(_analyses(spark, sf))


# --- comparison -------------------------------------------------------------------------------

_SCORES = "id, competitor_id, analyzed_at, overall_score, title_score"


@query("latest_per_key", f"WITH {_LATEST} SELECT {_SCORES} FROM latest", "seo_analyses")
def _(spark, sf):
    return co.latest_analyses(_analyses(spark, sf)).select(*_SCORES.split(", "))


@query("seo_history", f"""
SELECT {_SCORES} FROM (SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY analyzed_at DESC, id DESC) AS rn
FROM seo_analyses) WHERE rn <= 30""", "seo_analyses")
def _(spark, sf):
    return co.seo_history(_analyses(spark, sf)).select(*_SCORES.split(", "))


@query("compare_scores", f"""
WITH {_LATEST} SELECT competitor_id, c.name AS competitor_name, overall_score, title_score, l.content_score,
  technical_score, page_speed_score AS performance_score FROM latest l JOIN competitors c ON c.id = competitor_id""",
       "seo_analyses competitors")
def _(spark, sf):
    return co.compare_scores(_analyses(spark, sf), ev.competitors(spark, sf))


def _compared(spark, sf):
    return co.comparison_set(_analyses(spark, sf), ev.competitors(spark, sf))


_COMPARED = f"""{_LATEST}, compared AS (SELECT competitor_id, c.name AS competitor_name,
  {', '.join('l.' + k for k in KEYS)} FROM latest l JOIN competitors c ON c.id = competitor_id)"""
_VALUES = "vals AS (" + " UNION ALL ".join(
    f"SELECT competitor_id, competitor_name, '{key}' AS key, '{label}' AS metric, {i} AS ord, {key} AS value FROM compared"
    for i, (key, label, _) in enumerate(co.METRICS)) + ")"
_METRICS = f"""metrics AS (SELECT key, metric, ord,
  max(value) FILTER (competitor_id = {YOU}) AS your_value, {ev.sql_round('avg(value)', 1)} AS average,
  max(value) AS best_value, first(competitor_name ORDER BY value DESC, competitor_id) AS best_competitor,
  count(*) AS total FROM vals GROUP BY key, metric, ord),
full_metrics AS (SELECT *, coalesce((SELECT count(*) + 1 FROM vals v WHERE v.key = m.key AND v.value > m.your_value), 0)
  AS raw_rank FROM metrics m)"""
_RANKING = ("ranking AS (SELECT competitor_id, competitor_name, score, competitor_id = " + str(YOU) + " AS is_you, "
            "row_number() OVER (ORDER BY score DESC, competitor_id) AS rank FROM (SELECT *, "
            + ev.sql_round("((0.0::DOUBLE" + "".join(f" + {k} * {w}::DOUBLE" for k, _, w in co.METRICS) + ") / "
                           + repr(sum(w for _, _, w in co.METRICS)) + "::DOUBLE)", 1) + " AS score FROM compared))")


@query("metric_comparison", f"""
WITH {_COMPARED}, {_VALUES}, {_METRICS} SELECT key, metric, your_value, average, best_value, best_competitor,
  CASE WHEN your_value IS NULL THEN 0 ELSE raw_rank END AS your_rank, total FROM full_metrics""",
       "seo_analyses competitors")
def _(spark, sf):
    return co.metric_comparison(_compared(spark, sf), YOU).drop("metric_order")


@query("metric_values", f"WITH {_COMPARED}, {_VALUES} SELECT competitor_id, competitor_name, key, value FROM vals",
       "seo_analyses competitors")
def _(spark, sf):
    return co.metric_values(_compared(spark, sf))


@query("weighted_ranking", f"WITH {_COMPARED}, {_RANKING} SELECT * FROM ranking", "seo_analyses competitors")
def _(spark, sf):
    return co.weighted_ranking(_compared(spark, sf), YOU)


@query("competitive_insights", f"""
WITH {_COMPARED}, {_VALUES}, {_METRICS}, {_RANKING}, rows AS (
  SELECT -1 AS ord, NULL AS key, CASE WHEN rank = 1 THEN 'success' WHEN rank <= 3 THEN 'info' ELSE 'warning' END AS type,
    CASE WHEN rank = 1 THEN 'You''re leading in overall SEO with a score of ' || score
      WHEN rank <= 3 THEN 'You''re ranked #' || rank || ' in SEO performance'
      ELSE 'You''re ranked #' || rank || ' - significant room for improvement' END AS message, NULL AS priority
  FROM ranking WHERE is_you
  UNION ALL SELECT ord, key, CASE WHEN your_value >= best_value THEN 'success'
      WHEN your_value < average * 0.8::DOUBLE THEN 'danger' ELSE 'warning' END,
    CASE WHEN your_value >= best_value THEN 'Leading in ' || metric || ' (' || your_value || ')'
      WHEN your_value < average * 0.8::DOUBLE
        THEN metric || ' is ' || {ev.sql_round('(average - your_value)', 1)} || ' points below average'
      ELSE metric || ' slightly below average' END,
    CASE WHEN your_value < best_value AND your_value < average * 0.8::DOUBLE THEN 'high' END
  FROM metrics WHERE your_value >= best_value OR your_value < average)
SELECT CAST(pos AS INTEGER) AS pos, key, type, message, priority FROM (SELECT *, row_number() OVER (
  ORDER BY CASE WHEN priority = 'high' THEN 0 ELSE 1 END, ord) - 1 AS pos FROM rows) WHERE pos < 10""",
       "seo_analyses competitors")
def _(spark, sf):
    compared = _compared(spark, sf)
    return co.competitive_insights(co.metric_comparison(compared, YOU), co.weighted_ranking(compared, YOU), YOU)


@query("radar_matrix", f"WITH {_COMPARED} SELECT competitor_name AS label, "
       + ", ".join(f'{k} AS "{n}"' for k, n in co.RADAR_LABELS)
       + f", competitor_id = {YOU} AS is_you FROM compared", "seo_analyses competitors")
def _(spark, sf):
    return co.radar_matrix(_compared(spark, sf), YOU)


_RADAR_NAMES = ["Customer#000000001", "Customer#000000002", "Customer#000000003"]


@query("radar_by_metric", f"WITH {_COMPARED}, {_VALUES} SELECT CASE key " + " ".join(
    f"WHEN '{k}' THEN '{n}'" for k, n in co.RADAR_LABELS) + " END AS metric, " + ", ".join(
    f"max(value) FILTER (competitor_name = '{n}') AS \"{n}\"" for n in _RADAR_NAMES)
    + f" FROM vals WHERE competitor_name IN {tuple(_RADAR_NAMES)} GROUP BY key", "seo_analyses competitors")
def _(spark, sf):
    return co.radar_by_metric(_compared(spark, sf), _RADAR_NAMES)


_RECENT = f"analyzed_at >= TIMESTAMP '{ev.AS_OF_EVENTS}' - INTERVAL 14 DAYS"


@query("score_points", f"""
SELECT competitor_id, id, analyzed_at, overall_score, technical_score, content_score FROM seo_analyses
WHERE {_RECENT}""", "seo_analyses")
def _(spark, sf):
    return co.score_points(_analyses(spark, sf), ev.AS_OF_EVENTS, days=14)


@query("score_trend", f"""
SELECT competitor_id, points, first_score, last_score, CASE WHEN points >= 2 THEN last_score - first_score ELSE 0 END AS change,
  CASE WHEN points < 2 THEN 'neutral' WHEN last_score - first_score > 5 THEN 'improving'
    WHEN last_score - first_score < -5 THEN 'declining' ELSE 'stable' END AS trend
FROM (SELECT competitor_id, count(*) AS points, first(overall_score ORDER BY analyzed_at, id) AS first_score,
  last(overall_score ORDER BY analyzed_at, id) AS last_score FROM seo_analyses WHERE {_RECENT} GROUP BY 1)""",
       "seo_analyses")
def _(spark, sf):
    return co.score_trend(_analyses(spark, sf), ev.AS_OF_EVENTS, days=14)


_WINDOWS = ((3, "2024-01-30 12:00:00"), (14, "2024-01-30 12:00:00"), (400, "2024-01-25 00:00:00"))


@query("rolling_trend", " UNION ALL ".join(f"""
SELECT {days} AS days, competitor_id, points, first_score, last_score, mean_score,
  CASE WHEN points >= 2 THEN last_score - first_score ELSE 0 END AS change,
  CASE WHEN points < 2 THEN 'neutral' WHEN last_score - first_score > 5 THEN 'improving'
    WHEN last_score - first_score < -5 THEN 'declining' ELSE 'stable' END AS trend
FROM (SELECT competitor_id, count(*) AS points, first(overall_score ORDER BY analyzed_at, id) AS first_score,
  last(overall_score ORDER BY analyzed_at, id) AS last_score, sum(overall_score)::DOUBLE / count(*) AS mean_score
  FROM seo_analyses WHERE analyzed_at >= TIMESTAMP '{as_of}' - INTERVAL {days} DAYS GROUP BY 1)""" for days, as_of in _WINDOWS),
       "seo_analyses")
def _(spark, sf):
    # Two sets of summaries, as if half of the analyses had come later, stored once for all windows.
    analyses = _analyses(spark, sf)
    halves = [co.daily_scores(analyses.filter(F.pmod(F.hash("id"), F.lit(2)) == k)) for k in (0, 1)]
    daily = written(halves[0].unionByName(halves[1]), "daily-scores")
    trends = [co.rolling_trend(daily, analyses, as_of, days).withColumn("days", F.lit(days)) for days, as_of in _WINDOWS]
    return trends[0].unionByName(trends[1]).unionByName(trends[2])


@query("market_positioning", """
SELECT name, seo_score AS x, content_score AS y, health_score AS size, competitor_type AS type
FROM competitors WHERE is_active""", "competitors")
def _(spark, sf):
    return co.market_positioning(ev.competitors(spark, sf))


# --- gaps -------------------------------------------------------------------------------------

_FEATURE_GAPS = f"""
fx AS (SELECT lower(trim(feature_name)) AS feature, competitor_id FROM product_features),
fc AS (SELECT feature, count(*) AS mentions, count(DISTINCT competitor_id) FILTER (competitor_id <> {YOU}) AS competitors_with,
  bool_or(competitor_id = {YOU}) AS yours FROM fx GROUP BY feature),
fs AS (SELECT feature, mentions, competitors_with, (SELECT count(*) FROM sellers WHERE id <> {YOU}) AS competitors_total FROM fc
  WHERE NOT yours),
feature_gap AS (SELECT *, CAST(trunc(competitors_with::DOUBLE / competitors_total * 100) AS INTEGER) AS opportunity_score FROM fs)
"""
_SELLERS = "sellers AS (SELECT s_suppkey AS id, s_name AS name FROM supplier)"
_TITLED = "regexp_replace(feature, '^b', 'B')"


def _sellers(spark, sf):
    return ev.raw(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def _feature_gaps(spark, sf):
    return ga.feature_gaps(ev.product_features(spark, sf), _sellers(spark, sf), YOU)


_FEATURE_TOP = "SELECT * FROM feature_gap WHERE opportunity_score >= 20"


@query("feature_gaps", f"""
WITH {_SELLERS}, {_FEATURE_GAPS} SELECT {_TITLED} AS feature_name, 'Missing' AS your_status, competitors_with,
  competitors_total, opportunity_score FROM ({_FEATURE_TOP})""", "product_features")
def _(spark, sf):
    return _feature_gaps(spark, sf)


@query("feature_gap_coverage", f"""
WITH {_SELLERS}, {_FEATURE_GAPS} SELECT DISTINCT {_TITLED} AS feature_name, competitor_id
FROM fx JOIN ({_FEATURE_TOP}) USING (feature)""", "product_features")
def _(spark, sf):
    return ga.feature_gap_coverage(ev.product_features(spark, sf), _sellers(spark, sf), YOU)


_NAMES = ["small ring 0", "red widget 1", "blue bolt 2"]


def _sql_matrix(source: str, value: str) -> str:
    return (f"SELECT feature_name, c.name AS competitor_name, value FROM (SELECT feature_name, competitor_id, "
            f"first({value} ORDER BY product_id DESC, {value} DESC) AS value FROM {source} GROUP BY 1, 2) m "
            "JOIN sellers c ON c.id = m.competitor_id")


@query("feature_matrix", f"WITH {_SELLERS}, r AS (SELECT f.*, name FROM product_features f JOIN products p "
       f"ON p.id = f.product_id WHERE name IN {tuple(_NAMES)}) " + _sql_matrix("r", "feature_value"),
       "product_features products")
def _(spark, sf):
    return ga.feature_matrix(ev.product_features(spark, sf), ev.products(spark, sf), _sellers(spark, sf), _NAMES)


@query("feature_matrix_like", f"""
WITH {_SELLERS}, t AS (SELECT unnest(['WIDGET', 'bolt']) AS text),
chosen AS (SELECT DISTINCT competitor_id, min(p.id) AS product_id FROM products p JOIN t
  ON contains(lower(p.name), lower(t.text)) GROUP BY competitor_id, t.text),
r AS (SELECT f.* FROM product_features f JOIN chosen c ON c.product_id = f.product_id)
""" + _sql_matrix("r", "coalesce(feature_value, '✓')"), "product_features products")
def _(spark, sf):
    return ga.feature_matrix_like(ev.product_features(spark, sf), ev.products(spark, sf), _sellers(spark, sf),
                                  ["WIDGET", "bolt"])


@query("feature_presence", f"""
WITH {_SELLERS}, k AS (SELECT * FROM product_features WHERE feature_category = 'general'),
r AS (SELECT * FROM k WHERE feature_name IN (SELECT DISTINCT feature_name FROM k ORDER BY feature_name LIMIT 20))
""" + _sql_matrix("r", "coalesce(feature_value, 'Present')"), "product_features")
def _(spark, sf):
    return ga.feature_presence(ev.product_features(spark, sf), _sellers(spark, sf), "general", n=20)


@query("feature_presence_full", f"WITH {_SELLERS} " + _sql_matrix("product_features", "coalesce(feature_value, 'Present')"),
       "product_features")
def _(spark, sf):
    return ga.feature_presence(ev.product_features(spark, sf), _sellers(spark, sf))


_SITES = "sites AS (SELECT DISTINCT competitor_id AS id, 'Site ' || competitor_id AS name FROM content_base)"


def _sites(spark, sf):
    return ev.contents(spark, sf).select(F.col("competitor_id").alias("id")).distinct().withColumn(
        "name", F.concat(F.lit("Site "), "id"))


_TOPICS = """topics AS (SELECT competitor_id, keyword AS topic, content_type FROM content_keywords k
  JOIN contents b ON b.id = k.id WHERE keyword_pos < 5)"""
_CONTENT_GAPS = f"""
frequent AS (SELECT topic, count(*) AS mentions FROM topics GROUP BY topic),
covering AS (SELECT DISTINCT topic, competitor_id FROM (SELECT topic, competitor_id FROM topics UNION ALL
  SELECT w, competitor_id FROM (SELECT competitor_id, unnest({ev.sql_words('lower(title)')}) AS w FROM content_base)
  WHERE length(w) > 4) JOIN frequent USING (topic)),
covered AS (SELECT topic, count(*) FILTER (competitor_id <> {YOU}) AS competitors_with,
  bool_or(competitor_id = {YOU}) AS yours FROM covering GROUP BY topic),
content_gap AS (SELECT topic, mentions, competitors_with, (SELECT count(*) FROM sites WHERE id <> {YOU}) AS competitors_total
  FROM covered JOIN frequent USING (topic) WHERE NOT yours AND competitors_with >= 2),
content_top AS (SELECT *, CAST(trunc(competitors_with::DOUBLE / competitors_total * 100) AS INTEGER) AS opportunity_score
  FROM content_gap)"""


_ALL_TOPICS = _TOPICS.replace(" WHERE keyword_pos < 5", "")
#: The short lists read so many keywords of a page; the full ones all.
SHORT = 5


def _content_gaps(spark, sf, per_page=SHORT):
    return ga.content_gaps(ev.contents(spark, sf), _sites(spark, sf), YOU, per_page=per_page)


@query("content_gaps", f"""
WITH {_SITES}, {_TOPICS}, {_CONTENT_GAPS} SELECT upper(topic[1]) || topic[2:] AS topic, false AS your_coverage,
  competitors_with, competitors_total, opportunity_score FROM content_top""", "content_keywords contents")
def _(spark, sf):
    return _content_gaps(spark, sf)


@query("content_gaps_full", f"""
WITH {_SITES}, {_ALL_TOPICS}, {_CONTENT_GAPS} SELECT upper(topic[1]) || topic[2:] AS topic, false AS your_coverage,
  competitors_with, competitors_total, opportunity_score FROM content_top""", "content_keywords contents")
def _(spark, sf):
    return _content_gaps(spark, sf, None)


@query("content_gap_coverage", f"""
WITH {_SITES}, {_TOPICS}, {_CONTENT_GAPS} SELECT upper(topic[1]) || topic[2:] AS topic, competitor_id
FROM covering JOIN content_top USING (topic)""", "content_keywords contents")
def _(spark, sf):
    return ga.content_gap_coverage(ev.contents(spark, sf), _sites(spark, sf), YOU, per_page=SHORT)


@query("content_gap_coverage_full", f"""
WITH {_SITES}, {_ALL_TOPICS}, {_CONTENT_GAPS} SELECT upper(topic[1]) || topic[2:] AS topic, competitor_id
FROM covering JOIN content_top USING (topic)""", "content_keywords contents")
def _(spark, sf):
    return ga.content_gap_coverage(ev.contents(spark, sf), _sites(spark, sf), YOU)


@query("topic_coverage", f"""
WITH {_SITES}, {_TOPICS} SELECT topic, count(DISTINCT competitor_id) AS competitors_with,
  (SELECT count(*) FROM sites) AS competitors_total FROM topics GROUP BY topic
HAVING count(DISTINCT competitor_id) < (SELECT count(*) FROM sites)""", "content_keywords contents")
def _(spark, sf):
    return ga.topic_coverage(ev.contents(spark, sf), _sites(spark, sf), per_page=SHORT)


@query("topic_coverage_full", f"""
WITH {_SITES}, {_ALL_TOPICS} SELECT topic, count(DISTINCT competitor_id) AS competitors_with,
  (SELECT count(*) FROM sites) AS competitors_total FROM topics GROUP BY topic
HAVING count(DISTINCT competitor_id) < (SELECT count(*) FROM sites)""", "content_keywords contents")
def _(spark, sf):
    return ga.topic_coverage(ev.contents(spark, sf), _sites(spark, sf))


@query("topic_coverage_rows", f"""
WITH {_SITES}, {_TOPICS} SELECT DISTINCT topic, competitor_id FROM topics WHERE topic IN (
  SELECT topic FROM topics GROUP BY topic HAVING count(DISTINCT competitor_id) < (SELECT count(*) FROM sites))""",
       "content_keywords contents")
def _(spark, sf):
    return ga.topic_coverage_rows(ev.contents(spark, sf), _sites(spark, sf), per_page=SHORT)


@query("topic_coverage_rows_full", f"""
WITH {_SITES}, {_ALL_TOPICS} SELECT DISTINCT topic, competitor_id FROM topics WHERE topic IN (
  SELECT topic FROM topics GROUP BY topic HAVING count(DISTINCT competitor_id) < (SELECT count(*) FROM sites))""",
       "content_keywords contents")
def _(spark, sf):
    return ga.topic_coverage_rows(ev.contents(spark, sf), _sites(spark, sf))


@query("topic_matrix", f"""
WITH {_SITES}, {_TOPICS}, k AS (SELECT DISTINCT topic, competitor_id FROM topics WHERE content_type = 'other')
SELECT topic, s.name AS competitor_name FROM k JOIN sites s ON s.id = competitor_id
WHERE topic IN (SELECT DISTINCT topic FROM k ORDER BY topic LIMIT 20)""", "content_keywords contents")
def _(spark, sf):
    return ga.topic_matrix(ev.contents(spark, sf), _sites(spark, sf), "other", n=20, per_page=SHORT)


@query("topic_matrix_full", f"""
WITH {_SITES}, {_ALL_TOPICS} SELECT DISTINCT topic, s.name AS competitor_name FROM topics JOIN sites s ON s.id = competitor_id""",
       "content_keywords contents")
def _(spark, sf):
    return ga.topic_matrix(ev.contents(spark, sf), _sites(spark, sf))


_HISTORY_KW = """recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY competitor_id
    ORDER BY analyzed_at DESC, id DESC) AS rn FROM seo_analyses) WHERE rn <= 5),
used AS (SELECT DISTINCT lower(unnest([keyword_1, keyword_2, keyword_3])) AS keyword, competitor_id FROM recent
  WHERE has_keywords AND competitor_id IN (SELECT id FROM competitors)),
keyword_gap AS (SELECT keyword, count(*) AS competitors_ranking, CAST(greatest(100 - count(*) * 15, 10) AS INTEGER)
  AS opportunity_score FROM used WHERE length(keyword) > 3 GROUP BY keyword),
keyword_top AS (SELECT * FROM keyword_gap)"""


_ALL_KW = _HISTORY_KW.replace(" WHERE rn <= 5)", ")")


def _keyword_gaps(spark, sf, newest=SHORT, keywords=10):
    return ga.keyword_opportunities(_analyses(spark, sf), ev.competitors(spark, sf), newest_of_each=newest, per_analysis=keywords)


@query("keyword_opportunities", f"WITH {_HISTORY_KW} SELECT * FROM keyword_top", "seo_analyses competitors")
def _(spark, sf):
    return _keyword_gaps(spark, sf)


@query("keyword_opportunities_full", f"WITH {_ALL_KW} SELECT * FROM keyword_top", "seo_analyses competitors")
def _(spark, sf):
    return _keyword_gaps(spark, sf, None, None)


@query("keyword_opportunities_recent", """
WITH newest AS (SELECT * FROM seo_analyses WHERE competitor_id IN (SELECT id FROM competitors)
  ORDER BY analyzed_at DESC, id DESC LIMIT 100),
w AS (SELECT id, analyzed_at, unnest([keyword_1, keyword_2, keyword_3]) AS keyword, unnest([0, 1, 2]) AS kpos FROM newest
  WHERE has_keywords),
g AS (SELECT keyword, count(*) AS occurrences, max({'a': analyzed_at, 'i': id, 'b': -kpos}) AS seen FROM w GROUP BY keyword
  ORDER BY seen DESC, keyword LIMIT 20)
SELECT keyword, occurrences, CAST(greatest(100 - occurrences * 10, 20) AS INTEGER) AS opportunity_score FROM g""",
       "seo_analyses competitors")
def _(spark, sf):
    return ga.keyword_opportunities_recent(_analyses(spark, sf), ev.competitors(spark, sf), limit=20, window=100)


@query("keyword_opportunities_recent_full", """
WITH newest AS (SELECT * FROM seo_analyses WHERE competitor_id IN (SELECT id FROM competitors)),
w AS (SELECT id, analyzed_at, unnest([keyword_1, keyword_2, keyword_3]) AS keyword, unnest([0, 1, 2]) AS kpos FROM newest
  WHERE has_keywords),
g AS (SELECT keyword, count(*) AS occurrences, max({'a': analyzed_at, 'i': id, 'b': -kpos}) AS seen FROM w GROUP BY keyword)
SELECT keyword, occurrences, CAST(greatest(100 - occurrences * 10, 20) AS INTEGER) AS opportunity_score FROM g""",
       "seo_analyses competitors")
def _(spark, sf):
    return ga.keyword_opportunities_recent(_analyses(spark, sf), ev.competitors(spark, sf))


@query("gap_summary", f"""
WITH {_SELLERS}, {_FEATURE_GAPS}, {_SITES}, {_TOPICS}, {_CONTENT_GAPS}, {_HISTORY_KW},
n AS (SELECT (SELECT count(*) FROM ({_FEATURE_TOP})) AS f, (SELECT count(*) FROM content_top) AS c,
  (SELECT count(*) FROM keyword_top) AS k)
SELECT f AS feature_gaps, c AS content_gaps, k AS keyword_opportunities,
  greatest(0, 100 - (f + c + k) * 2) AS overall_opportunity_score FROM n""",
       "product_features content_keywords contents seo_analyses competitors")
def _(spark, sf):
    return ga.gap_summary(_feature_gaps(spark, sf), _content_gaps(spark, sf), _keyword_gaps(spark, sf))


@query("gap_summary_full", f"""
WITH {_SELLERS}, {_FEATURE_GAPS}, {_SITES}, {_ALL_TOPICS}, {_CONTENT_GAPS}, {_ALL_KW},
n AS (SELECT (SELECT count(*) FROM ({_FEATURE_TOP})) AS f, (SELECT count(*) FROM content_top) AS c,
  (SELECT count(*) FROM keyword_top) AS k)
SELECT f AS feature_gaps, c AS content_gaps, k AS keyword_opportunities,
  greatest(0, 100 - (f + c + k) * 2) AS overall_opportunity_score FROM n""",
       "product_features content_keywords contents seo_analyses competitors")
def _(spark, sf):
    return ga.gap_summary(_feature_gaps(spark, sf), _content_gaps(spark, sf, None), _keyword_gaps(spark, sf, None, None))

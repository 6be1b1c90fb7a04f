"""Queries: dashboards, lists, statistics and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from marketlens.operators import dashboards as da
from marketlens.operators import listings as li
from marketlens.operators.search import TrigramIndex
from marketlens.plans import entity_views as ev
from marketlens.plans.registry import query
from marketlens.session import scratch_dir
from marketlens.sources import sinks, tables

_AT = f"TIMESTAMP '{ev.AS_OF_EVENTS}'"


@query("dashboard_metrics", f"""
WITH c AS (SELECT count(*) FILTER (detected_at >= {_AT} - INTERVAL 24 HOURS) AS v,
    count(*) FILTER (detected_at < {_AT} - INTERVAL 24 HOURS) AS p
  FROM content_changes WHERE detected_at >= {_AT} - INTERVAL 48 HOURS AND detected_at <= {_AT}),
d AS (SELECT v, CASE WHEN p > 0 THEN {ev.sql_round('((v - p)::DOUBLE / p * 100)', 1)}
    WHEN v = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS pct FROM c)
SELECT 'Total Competitors' AS label, count(*) FILTER (is_active) AS value, NULL::DOUBLE AS change,
  NULL AS change_direction FROM competitors
UNION ALL SELECT 'Changes (24h)', v, abs(pct), CASE WHEN pct > 0 THEN 'up' WHEN pct < 0 THEN 'down'
  ELSE 'neutral' END FROM d
UNION ALL SELECT 'Active Monitors', count(*) FILTER (status = 'running'), NULL, NULL FROM scans
UNION ALL SELECT 'Critical Alerts', count(*) FILTER (NOT is_read AND severity IN ('high', 'critical')),
  NULL, NULL FROM alerts""", "competitors content_changes scans alerts")
def _(spark, sf):
    return da.dashboard_metrics(ev.competitors(spark, sf), ev.content_changes(spark, sf), ev.scans(spark, sf),
                                ev.alerts(spark, sf), ev.AS_OF_EVENTS)


@query("activity_feed", """
SELECT ch.id, change_type AS type, 'Content ' || change_type AS title,
  field_changed || ' was ' || change_type AS description, c.name AS competitor_name, detected_at AS timestamp
FROM content_changes ch JOIN content_base b ON b.id = ch.content_id JOIN competitors c ON c.id = b.competitor_id
ORDER BY detected_at DESC, ch.id DESC LIMIT 10""", "content_changes content_base competitors")
def _(spark, sf):
    return da.activity_feed(ev.content_changes(spark, sf), ev.contents(spark, sf), ev.competitors(spark, sf))


@query("health_breakdown", """
SELECT CAST(trunc(avg(health_score)) AS INTEGER) AS overall_score, count(*) FILTER (health_score >= 70) AS strengths,
  count(*) FILTER (health_score >= 40 AND health_score < 70) AS neutrals,
  count(*) FILTER (health_score < 40) AS alerts FROM competitors WHERE is_active""", "competitors")
def _(spark, sf):
    return da.health_breakdown(ev.competitors(spark, sf))


@query("current_scan", """
SELECT id, progress, current_url, pages_crawled, pages_discovered FROM scans WHERE status = 'running'
ORDER BY started_at DESC, id DESC LIMIT 1""", "scans")
def _(spark, sf):
    return da.current_scan(ev.scans(spark, sf))


@query("entity_counts", """
SELECT 'competitors' AS entity, count(*) FILTER (is_active) AS rows FROM competitors
UNION ALL SELECT 'scans', count(*) FROM scans UNION ALL SELECT 'contents', count(*) FROM content_base
UNION ALL SELECT 'unread_alerts', count(*) FILTER (NOT is_read) FROM alerts""",
       "competitors scans content_base alerts")
def _(spark, sf):
    return da.entity_counts(ev.competitors(spark, sf), ev.scans(spark, sf), ev.contents(spark, sf),
                            ev.alerts(spark, sf))


_COMPETITOR = ["id", "name", "domain", "competitor_type", "is_monitoring", "created_at"]


@query("list_competitors", f"""
SELECT {', '.join(_COMPETITOR)} FROM competitors
WHERE is_active AND competitor_type = 'direct' AND is_monitoring
ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10""", "competitors")
def _(spark, sf):
    return li.list_competitors(ev.competitors(spark, sf), "direct", True, skip=10).select(*_COMPETITOR)


@query("search_competitors", f"""
SELECT {', '.join(_COMPETITOR)} FROM competitors WHERE competitor_type = 'indirect'
AND (contains(lower(name), 'site7') OR contains(lower(domain), 'site7'))""", "competitors")
def _(spark, sf):
    return li.search_competitors(ev.competitors(spark, sf), "SITE7", "indirect").select(*_COMPETITOR)


_SEARCHED = ["BOLT", "old w", "customer#00000012", "rin", "t", "Nowhere", "#%_", "0000"]


@query("search_by_trigrams", " UNION ALL ".join(f"""
SELECT '{t}' AS text, id, name FROM (SELECT p_partkey AS id, p_name AS name, p_type AS kind FROM part
  UNION ALL SELECT c_custkey + 1000000, c_name, c_mktsegment FROM customer)
WHERE contains(lower(name), lower('{t}')) OR contains(lower(kind), lower('{t}'))""" for t in _SEARCHED))
def _(spark, sf):
    named = ev.raw(spark, sf, "part").selectExpr("p_partkey AS id", "p_name AS name", "p_type AS kind").unionByName(
        ev.raw(spark, sf, "customer").selectExpr("c_custkey + 1000000 AS id", "c_name AS name", "c_mktsegment AS kind"))
    index = TrigramIndex(spark, scratch_dir(spark, "trigrams"), named.schema["id"], ["name", "kind"], buckets=8)
    index.add(named.filter("id < 1000000"), "parts")
    index.add(named.filter("id >= 1000000"), "customers")
    found = [index.search(named, t).select(F.lit(t).alias("text"), "id", "name") for t in _SEARCHED]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("list_content", """
SELECT id, competitor_id, url, content_type, word_count, has_changed, last_checked FROM contents
WHERE has_changed AND content_type = 'other' ORDER BY last_checked DESC, id DESC LIMIT 100""", "contents")
def _(spark, sf):
    return li.list_content(ev.contents(spark, sf), content_type="other", has_changed=True).select(
        "id", "competitor_id", "url", "content_type", "word_count", "has_changed", "last_checked")


@query("content_changes", """
SELECT id, competitor_id, content_id, change_type, detected_at FROM (
  SELECT ch.*, b.competitor_id, row_number() OVER (PARTITION BY b.competitor_id
    ORDER BY detected_at DESC, ch.id DESC) AS rn
  FROM content_changes ch JOIN content_base b ON b.id = ch.content_id) WHERE rn <= 50""",
       "content_changes content_base")
def _(spark, sf):
    return li.content_changes(ev.content_changes(spark, sf), ev.contents(spark, sf)).select(
        "id", "competitor_id", "content_id", "change_type", "detected_at")


@query("latest_change_per_page", """
SELECT b.id AS content_id, b.url, b.title, l.old_value AS old_content, l.new_value AS new_content,
  coalesce(l.detected_at, b.last_checked) AS detected_at
FROM content_base b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY content_id
  ORDER BY detected_at DESC, id DESC) AS rn FROM content_changes) l ON l.content_id = b.id AND l.rn = 1""",
       "content_changes content_base")
def _(spark, sf):
    return li.latest_change_per_page(ev.contents(spark, sf), ev.content_changes(spark, sf))


_PRODUCT = ["id", "competitor_id", "name", "category", "is_available", "is_new", "last_checked"]


@query("list_products", f"""
SELECT {', '.join(_PRODUCT)} FROM products WHERE category = 'ECONOMY' AND is_available AND is_new
ORDER BY last_checked DESC, id DESC LIMIT 100""", "products")
def _(spark, sf):
    return li.list_products(ev.products(spark, sf), category="ECONOMY", is_available=True, is_new=True).select(
        *_PRODUCT)


@query("product_counts", """
SELECT competitor_id, count(*) AS products, count(*) FILTER (is_new) AS new,
  count(*) FILTER (NOT is_available) AS unavailable FROM products GROUP BY competitor_id""", "products")
def _(spark, sf):
    return li.product_counts(ev.products(spark, sf))


@query("product_detail", """
SELECT p.id, p.competitor_id, name, description, category, is_available, feature_name, feature_value,
  feature_category FROM products p LEFT JOIN product_features f ON f.product_id = p.id""",
       "products product_features")
def _(spark, sf):
    return li.product_detail(ev.products(spark, sf), ev.product_features(spark, sf)).select(
        "id", "competitor_id", "name", "description", "category", "is_available", "feature_name",
        "feature_value", "feature_category")


@query("new_products", f"""
SELECT p.id, c.name AS competitor_name, p.name, p.url, category, image_url, first_seen
FROM products p JOIN competitors c ON c.id = p.competitor_id
WHERE first_seen >= TIMESTAMP '{ev.AS_OF_PRICES}' - INTERVAL 7 DAYS
ORDER BY first_seen DESC, p.id DESC LIMIT 50""", "products competitors")
def _(spark, sf):
    return li.new_products(ev.products(spark, sf), ev.competitors(spark, sf), ev.AS_OF_PRICES)


@query("product_categories", "SELECT DISTINCT category FROM products WHERE category IS NOT NULL", "products")
def _(spark, sf):
    return li.product_categories(ev.products(spark, sf))


_ALERT = ["id", "competitor_id", "alert_type", "severity", "title", "is_read", "created_at"]


@query("list_alerts", f"""
SELECT {', '.join(_ALERT)} FROM alerts WHERE NOT is_dismissed AND NOT is_read AND severity = 'high'
AND alert_type = 'click' ORDER BY created_at DESC, id DESC LIMIT 50""", "alerts")
def _(spark, sf):
    return li.list_alerts(ev.alerts(spark, sf), False, "high", "click").select(*_ALERT)


@query("recent_alerts", f"""
SELECT {', '.join(_ALERT)} FROM alerts WHERE NOT is_dismissed ORDER BY created_at DESC, id DESC LIMIT 5""",
       "alerts")
def _(spark, sf):
    return li.recent_alerts(ev.alerts(spark, sf)).select(*_ALERT)


@query("alert_stats", """
SELECT count(*) AS total, count(*) FILTER (NOT is_read) AS unread, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low FROM alerts WHERE NOT is_dismissed""", "alerts")
def _(spark, sf):
    return li.alert_stats(ev.alerts(spark, sf))


@query("unread_count", "SELECT count(*) AS count FROM alerts WHERE NOT is_dismissed AND NOT is_read", "alerts")
def _(spark, sf):
    return li.unread_count(ev.alerts(spark, sf))


_SCAN = ["id", "competitor_id", "status", "progress", "pages_crawled", "pages_discovered", "created_at"]


@query("list_scans", f"""
SELECT {', '.join(_SCAN)} FROM scans WHERE status = 'failed' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 20""",
       "scans")
def _(spark, sf):
    return li.list_scans(ev.scans(spark, sf), status="failed", skip=20).select(*_SCAN)


@query("scan_history", f"""
SELECT {', '.join(_SCAN)} FROM (SELECT *, row_number() OVER (PARTITION BY competitor_id
  ORDER BY created_at DESC, id DESC) AS rn FROM scans) WHERE rn <= 10""", "scans")
def _(spark, sf):
    return li.scan_history(ev.scans(spark, sf)).select(*_SCAN)


@query("running_scans", """
SELECT s.id, competitor_id, c.name AS competitor_name, status, progress, pages_crawled, pages_discovered,
  current_url, started_at, s.created_at FROM scans s JOIN competitors c ON c.id = s.competitor_id
WHERE status = 'running'""", "scans competitors")
def _(spark, sf):
    return li.running_scans(ev.scans(spark, sf), ev.competitors(spark, sf))


@query("scan_detail", f"""
SELECT id, competitor_name, status, pages_crawled, duration_seconds, CASE WHEN duration_seconds > 0
  THEN {ev.sql_round('(pages_crawled::DOUBLE / (duration_seconds::DOUBLE / 60))', 2)} END AS pages_per_minute
FROM (SELECT s.*, c.name AS competitor_name, date_diff('second', started_at, completed_at) AS duration_seconds
  FROM scans s JOIN competitors c ON c.id = s.competitor_id)""", "scans competitors")
def _(spark, sf):
    return li.scan_detail(ev.scans(spark, sf), ev.competitors(spark, sf)).select(
        "id", "competitor_name", "status", "pages_crawled", "duration_seconds", "pages_per_minute")


@query("scan_pages", """
SELECT scan_id, page, url, word_count, crawled_at FROM (SELECT *, row_number() OVER (PARTITION BY scan_id
  ORDER BY crawled_at DESC, page DESC, url DESC, word_count DESC) AS rn FROM scan_pages)
WHERE rn > 1 AND rn <= 101""", "scan_pages")
def _(spark, sf):
    return li.scan_pages(ev.scan_pages(spark, sf), skip=1, tie=("page", "url", "word_count")).select(
        "scan_id", "page", "url", "word_count", "crawled_at")


@query("scan_stats", f"""
SELECT count(*) AS total_scans, count(*) FILTER (status = 'completed') AS completed_scans,
  count(*) FILTER (status = 'running') AS running_scans, count(*) FILTER (status = 'failed') AS failed_scans,
  CAST(sum(pages_crawled) AS BIGINT) AS total_pages_crawled,
  {ev.sql_round('(sum(pages_crawled)::DOUBLE / count(*))', 1)} AS avg_pages_per_scan,
  {ev.sql_round("avg(date_diff('second', started_at, completed_at))", 1)} AS avg_duration_seconds
FROM scans""", "scans")
def _(spark, sf):
    return li.scan_stats(ev.scans(spark, sf))


@query("content_stats", """
SELECT competitor_id, count(*) AS total_pages, CAST(sum(word_count) AS BIGINT) AS total_words,
  CAST(sum(word_count) // count(*) AS BIGINT) AS average_words, count(*) FILTER (has_changed) AS changed_pages,
""" + ", ".join(f"count(*) FILTER (content_type = '{c}') AS {c}_pages" for c in (
    "blog", "product", "pricing", "documentation", "about", "contact", "landing", "other")) + """
FROM contents GROUP BY competitor_id""", "contents")
def _(spark, sf):
    return li.content_stats(ev.contents(spark, sf))


@query("due_for_monitoring", f"""
SELECT {', '.join(_COMPETITOR)} FROM competitors WHERE is_active AND is_monitoring
AND id NOT IN (SELECT competitor_id FROM scans WHERE status = 'running')""", "competitors scans")
def _(spark, sf):
    return li.due_for_monitoring(ev.competitors(spark, sf), ev.scans(spark, sf)).select(*_COMPETITOR)


@query("scan_rollup", """
SELECT s.id, competitor_id, coalesce(n, 0) AS pages_crawled,
  CASE WHEN n IS NULL THEN progress ELSE 100 END AS progress,
  CASE WHEN n IS NULL THEN status ELSE 'completed' END AS status
FROM scans s LEFT JOIN (SELECT scan_id, count(*) AS n FROM scan_pages GROUP BY scan_id) p ON p.scan_id = s.id""",
       "scans scan_pages")
def _(spark, sf):
    return li.scan_rollup(ev.scan_pages(spark, sf), ev.scans(spark, sf)).select(
        "id", "competitor_id", "pages_crawled", "progress", "status")


# --- retention, table reads ----------------------------------------------------------------

_RECENT = f"created_at >= TIMESTAMP '{ev.AS_OF_SCANS}' - INTERVAL 365 DAYS"


@query("retain_recent", f"SELECT {', '.join(_SCAN)} FROM scans WHERE {_RECENT}", "scans")
def _(spark, sf):
    return sinks.retain_recent(ev.scans(spark, sf), ev.AS_OF_SCANS, days=365).select(*_SCAN)


@query("retain_recent_pages", f"""
SELECT scan_id, page, url, crawled_at FROM scan_pages
WHERE scan_id IN (SELECT id FROM scans WHERE {_RECENT})""", "scans scan_pages")
def _(spark, sf):
    kept = sinks.retain_recent(ev.scans(spark, sf), ev.AS_OF_SCANS, days=365)
    return sinks.retain_children(ev.scan_pages(spark, sf), kept, "scan_id").select(
        "scan_id", "page", "url", "crawled_at")


@query("retain_last_n", f"""
SELECT {', '.join(_SCAN)} FROM (SELECT *, row_number() OVER (PARTITION BY competitor_id
  ORDER BY created_at DESC, id DESC) AS rn FROM scans) WHERE rn <= 5""", "scans")
def _(spark, sf):
    return sinks.retain_last_n(ev.scans(spark, sf)).select(*_SCAN)


@query("read_keywords_json", """
SELECT id, keyword, keyword_pos FROM (
  SELECT id, keyword_1 AS keyword, 0 AS keyword_pos FROM seo_analyses WHERE has_keywords
  UNION ALL SELECT id, keyword_2, 1 FROM seo_analyses WHERE has_keywords
  UNION ALL SELECT id, keyword_3, 2 FROM seo_analyses WHERE has_keywords)""", "seo_analyses")
def _(spark, sf):
    rows = tables.read_keywords_json(ev.seo_analyses(spark, sf), "keyword_density")
    return rows.select("id", "keyword", "keyword_pos")


@query("read_table", "SELECT * FROM lineitem")
def _(spark, sf):
    schema = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
              "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
              "l_linestatus string, l_shipdate timestamp_ntz")
    return tables.read_parquet(spark, f"{sf}/lineitem.parquet", schema)


@query("append_snapshot", """
SELECT CAST(captured_at AS DATE)::VARCHAR AS snapshot_date, count(*) AS captures, sum(price)::DECIMAL(22,2) AS total
FROM price_history GROUP BY 1""", "price_history")
def _(spark, sf):
    path = scratch_dir(spark, "snapshots")
    history = ev.price_history(spark, sf).withColumn("month", F.trunc("captured_at", "month"))
    # Laid out by month here: the given table spans years with few rows a day.
    sinks.append_snapshot(history.filter("is_on_sale"), path, "month")
    sinks.append_snapshot(history.filter("NOT is_on_sale"), path, "month")
    return spark.read.parquet(path).groupBy(F.to_date("captured_at").cast("string").alias("snapshot_date")).agg(
        F.count(F.lit(1)).alias("captures"), F.sum("price").alias("total"))


@query("append_snapshot_once", """
SELECT CAST(captured_at AS DATE)::VARCHAR AS snapshot_date, count(*) AS captures, sum(price)::DECIMAL(22,2) AS total
FROM price_history GROUP BY 1""", "price_history")
def _(spark, sf):
    history = ev.price_history(spark, sf).withColumn("month", F.trunc("captured_at", "month"))
    log = sinks.SnapshotLog(spark, scratch_dir(spark, "snapshot-log"), "month")
    sale, rest = history.filter("is_on_sale"), history.filter("NOT is_on_sale")
    log.append(sale, "1")
    log.append(sale, "1")  # the same batch again
    log._put(rest.filter("price > 1000"), "b-2")  # a batch that broke off before its entry
    log.append(rest, "2")
    log.compact("all")
    log.append(rest, "2")
    return log.read().groupBy(F.to_date("captured_at").cast("string").alias("snapshot_date")).agg(
        F.count(F.lit(1)).alias("captures"), F.sum("price").alias("total"))

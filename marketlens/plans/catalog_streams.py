"""Queries: the streaming forms, run over the given files and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.plans import entity_views as ev
from marketlens.plans.catalog_prices import _CHANGES_SQL, _half_even
from marketlens.plans.registry import query
from marketlens.plans.skew import latest_per_key
from marketlens.session import scratch_dir
from marketlens.streaming import changes as st
from marketlens.streaming import runs
from marketlens.streaming.corrections import settle
from marketlens.streaming.seen import SeenTable, dedupe_stored

LINEITEM = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
            "l_extendedprice double, l_discount double, l_shipdate timestamp_ntz")
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DOCUMENTS = "doc_id bigint, text string, lang string, source string"


def _arriving(spark, sf, table, schema, parts, keys=()):
    """The table as a stream whose rows come part after part, in as many micro-batches at most.

    ``parts`` are conditions that share the rows out; parts of a time order let a
    key's rows come in time, parts by hash bring times in disorder. A part's rows of
    the same ``keys`` lie in one file, so wherever a micro-batch ends, it takes them
    together.
    """
    folder = scratch_dir(spark, f"arriving-{table}")
    rows = ev.raw(spark, sf, table).selectExpr(*[f"`{f.split()[0]}`" for f in schema.split(", ")])
    for part in parts:
        arrived = rows.filter(part)
        (arrived.repartition(*keys) if keys else arrived).write.mode("append").parquet(folder)
    return _in_batches(spark, folder, schema, len(parts))


def _in_batches(spark, folder, schema, batches):
    """The files of a folder as a stream of at most ``batches`` micro-batches, however many files there are."""
    files = len(spark.read.schema(schema).parquet(folder).inputFiles())
    return runs.read_stream(spark, folder, schema, per_trigger=max(1, -(-files // batches)))


def _shares(column, n=5):
    return [f"coalesce(pmod(hash({column}), {n}), 0) = {i}" for i in range(n)]


_IN_TIME = ["year(l_shipdate) <= 1995", "year(l_shipdate) IN (1996, 1997)", "year(l_shipdate) = 1998", "year(l_shipdate) >= 1999"]


#: What a crawled page is made of.
CRAWLED = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_shipdate timestamp_ntz"


def _lines(spark, sf, parts=None, schema=LINEITEM):
    if parts:
        return _arriving(spark, sf, "lineitem", schema, parts)
    return _arriving(spark, sf, "lineitem", LINEITEM, _IN_TIME, ["l_suppkey", "l_partkey"])


def _events(spark, sf):
    return _arriving(spark, sf, "events", EVENTS, _shares("event_id"))


@query("stream_price_changes", _CHANGES_SQL.replace("product_name ORDER", "product_id ORDER") + f"""
SELECT competitor_id, product_id, captured_at, order_key, line_number, price, old_price, status,
  CASE WHEN status IN ('increase', 'decrease')
    THEN CAST(CAST({_half_even(2)} AS DECIMAL(18,2)) / 100 AS DECIMAL(10,2)) END AS change_percentage
FROM price_changes""", "price_history")
def _(spark, sf):
    snapshots = _lines(spark, sf).selectExpr(
        "l_suppkey AS competitor_id", "l_partkey AS product_id", "CAST(l_shipdate AS TIMESTAMP) AS captured_at",
        "l_orderkey AS order_key", "l_linenumber AS line_number", "CAST(l_extendedprice AS DECIMAL(12,2)) AS price")
    changed = st.stream_price_changes(snapshots, ("competitor_id", "product_id"),
                                      tie=("order_key", "line_number", "price"))
    return runs.drain(changed, "price-changes").drop("late").withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))


_TWO_CRAWLS = """SELECT CAST(substring(source, 4) AS BIGINT) AS competitor_id, doc_id,
  'https://' || source || '.example.com/' || lang || '/' || doc_id AS url,
  CASE WHEN crawl = 2 AND lang = 'de' THEN text || ' Neu im Angebot.' ELSE text END AS text_content, crawl
FROM documents, (VALUES (1), (2)) v(crawl) WHERE crawl = 2 OR lang <> 'es'"""


@query("stream_content_changes", f"""
WITH crawls AS ({_TWO_CRAWLS}), kept AS (SELECT *, {ev.sql_content_hash('text_content')} AS new_hash FROM crawls
  WHERE length(text_content) >= 100),
linked AS (SELECT *, lag(new_hash) OVER (PARTITION BY competitor_id, url ORDER BY crawl) AS old_hash FROM kept)
SELECT competitor_id, url, crawl, new_hash, old_hash, CASE WHEN old_hash IS NULL THEN 'new'
  WHEN new_hash <> old_hash THEN 'updated' ELSE 'unchanged' END AS status FROM linked""")
def _(spark, sf):
    docs = _arriving(spark, sf, "documents", DOCUMENTS, _shares("doc_id", 4), ["doc_id"])
    crawls = docs.withColumn("crawl", F.explode(F.when(F.col("lang") == "es", F.array(F.lit(2))).otherwise(
        F.array(F.lit(1), F.lit(2))))).selectExpr(
        "CAST(substring(source, 4) AS BIGINT) AS competitor_id",
        "concat('https://', source, '.example.com/', lang, '/', doc_id) AS url",
        "CASE WHEN crawl = 2 AND lang = 'de' THEN concat(text, ' Neu im Angebot.') ELSE text END AS text_content",
        "crawl", "CAST(make_timestamp_ntz(2024, crawl, 1, 0, 0, 0) AS TIMESTAMP) AS checked_at", "doc_id")
    # Documents without a url share one; they are taken in the order of doc_id.
    changed = st.stream_content_changes(crawls, tie=("doc_id",))
    return runs.drain(changed, "content-changes").select(
        "competitor_id", "url", "crawl", "new_hash", "old_hash", "status")


@query("stream_product_changes", """
WITH cards AS (SELECT l_suppkey AS competitor_id, l_partkey AS product_id, l_shipdate AS checked_at, l_orderkey AS k,
    l_linenumber AS n, l_extendedprice AS p, l_quantity > 5 AS is_available,
    sha256('pack of ' || CASE WHEN l_discount > 0.05 THEN 2 ELSE 1 END) AS h FROM lineitem),
linked AS (SELECT *, lag(h) OVER w AS old_h, lag(is_available) OVER w AS was FROM cards
  WINDOW w AS (PARTITION BY competitor_id, product_id ORDER BY checked_at, k, n, p))
SELECT competitor_id, product_id AS name, k AS order_key, n AS line_number, h AS description_hash, is_available,
  CASE WHEN old_h IS NULL THEN 'new' WHEN old_h <> h OR was <> is_available THEN 'updated' ELSE 'unchanged' END AS status,
  coalesce(was AND NOT is_available, false) AS went_unavailable FROM linked""")
def _(spark, sf):
    cards = _lines(spark, sf).selectExpr(
        "l_suppkey AS competitor_id", "l_partkey AS name", "CAST(l_shipdate AS TIMESTAMP) AS checked_at",
        "l_orderkey AS order_key", "l_linenumber AS line_number", "l_extendedprice AS shown",
        "l_quantity > 5 AS is_available",
        "concat('pack of ', CASE WHEN l_discount > 0.05 THEN 2 ELSE 1 END) AS description")
    changed = st.stream_product_changes(cards, tie=("order_key", "line_number", "shown"))
    return runs.drain(changed, "product-changes").select(
        "competitor_id", "name", "order_key", "line_number", "description_hash", "is_available", "status",
        "went_unavailable")


# --- the same changes from rows in no order of time, some without a time: late rows correct the ones after them ---

_NO_TIME = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate END"


@query("stream_price_corrections", f"""
WITH price_history AS (SELECT l_suppkey AS competitor_id, l_partkey AS product_id, {_NO_TIME} AS captured_at,
    l_orderkey AS order_key, l_linenumber AS line_number, CAST(l_extendedprice AS DECIMAL(12,2)) AS price FROM lineitem),
linked AS (SELECT *, lag(price) OVER (PARTITION BY competitor_id, product_id
    ORDER BY captured_at NULLS FIRST, order_key, line_number, price) AS old_price FROM price_history),
cents AS (SELECT *, CAST(price * 100 AS BIGINT) AS nc, CAST(old_price * 100 AS BIGINT) AS oc FROM linked)
SELECT competitor_id, product_id, captured_at, order_key, line_number, price, old_price,
  CASE WHEN oc IS NULL THEN 'new' WHEN oc = nc OR abs(nc - oc) * 100 < oc THEN 'unchanged'
    WHEN nc > oc THEN 'increase' ELSE 'decrease' END AS status,
  CASE WHEN oc IS NOT NULL AND oc <> nc AND abs(nc - oc) * 100 >= oc
    THEN CAST(CAST({_half_even(2)} AS DECIMAL(18,2)) / 100 AS DECIMAL(10,2)) END AS change_percentage FROM cents""")
def _(spark, sf):
    snapshots = _lines(spark, sf, _shares("l_orderkey")).selectExpr(
        "l_suppkey AS competitor_id", "l_partkey AS product_id", f"CAST({_NO_TIME} AS TIMESTAMP) AS captured_at",
        "l_orderkey AS order_key", "l_linenumber AS line_number", "CAST(l_extendedprice AS DECIMAL(12,2)) AS price")
    now = settle(snapshots, "price-corrections", lambda path, schema: st.price_corrections(
        path, schema, ("competitor_id", "product_id"), tie=("order_key", "line_number", "price")))
    return now.withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))


@query("stream_content_corrections", f"""
WITH crawls AS ({_TWO_CRAWLS}), kept AS (SELECT *, {ev.sql_content_hash('text_content')} AS new_hash FROM crawls
  WHERE length(text_content) >= 100),
linked AS (SELECT *, lag(new_hash) OVER (PARTITION BY competitor_id, url ORDER BY crawl) AS old_hash FROM kept)
SELECT competitor_id, url, crawl, new_hash, old_hash, CASE WHEN old_hash IS NULL THEN 'new'
  WHEN new_hash <> old_hash THEN 'updated' ELSE 'unchanged' END AS status FROM linked""")
def _(spark, sf):
    # Of many documents the second crawl comes first.
    crawls = ev.raw(spark, sf, "documents").withColumn("crawl", F.explode(F.when(F.col("lang") == "es", F.array(
        F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2))))).selectExpr("doc_id", "text", "lang", "source", "crawl")
    folder = scratch_dir(spark, "arriving-crawls")
    for part in range(3):
        crawls.filter(f"pmod(hash(doc_id, crawl), 3) = {part}").write.mode("append").parquet(folder)
    docs = _in_batches(spark, folder, DOCUMENTS + ", crawl int", 3)
    pages = docs.selectExpr(
        "CAST(substring(source, 4) AS BIGINT) AS competitor_id",
        "concat('https://', source, '.example.com/', lang, '/', doc_id) AS url",
        "CASE WHEN crawl = 2 AND lang = 'de' THEN concat(text, ' Neu im Angebot.') ELSE text END AS text_content",
        "crawl", "CAST(make_timestamp_ntz(2024, crawl, 1, 0, 0, 0) AS TIMESTAMP) AS checked_at")
    return settle(st.hashed_pages(pages), "content-corrections", st.content_corrections).select(
        "competitor_id", "url", "crawl", "new_hash", "old_hash", "status")


@query("stream_product_corrections", f"""
WITH cards AS (SELECT l_suppkey AS competitor_id, l_partkey AS product_id, {_NO_TIME} AS checked_at, l_orderkey AS k,
    l_linenumber AS n, l_extendedprice AS p, l_quantity > 5 AS is_available,
    sha256('pack of ' || CASE WHEN l_discount > 0.05 THEN 2 ELSE 1 END) AS h FROM lineitem),
linked AS (SELECT *, lag(h) OVER w AS old_h, lag(is_available) OVER w AS was FROM cards
  WINDOW w AS (PARTITION BY competitor_id, product_id ORDER BY checked_at NULLS FIRST, k, n, p))
SELECT competitor_id, product_id AS name, k AS order_key, n AS line_number, h AS description_hash, is_available,
  CASE WHEN old_h IS NULL THEN 'new' WHEN old_h <> h OR was <> is_available THEN 'updated' ELSE 'unchanged' END AS status,
  coalesce(was AND NOT is_available, false) AS went_unavailable FROM linked""")
def _(spark, sf):
    cards = _lines(spark, sf, _shares("l_orderkey")).selectExpr(
        "l_suppkey AS competitor_id", "l_partkey AS name", f"CAST({_NO_TIME} AS TIMESTAMP) AS checked_at",
        "l_orderkey AS order_key", "l_linenumber AS line_number", "l_extendedprice AS shown",
        "l_quantity > 5 AS is_available",
        "concat('pack of ', CASE WHEN l_discount > 0.05 THEN 2 ELSE 1 END) AS description")
    now = settle(st.hashed_cards(cards), "product-corrections", lambda path, schema: st.product_corrections(
        path, schema, tie=("order_key", "line_number", "shown")))
    return now.select("competitor_id", "name", "order_key", "line_number", "description_hash", "is_available", "status",
                      "went_unavailable")


@query("changes_per_day", """
WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS changes FROM events
  WHERE event_type IN ('view', 'click') GROUP BY 1),
c AS (SELECT day AS day_start, changes, coalesce((SELECT changes FROM d p WHERE p.day = d.day - INTERVAL 1 DAY), 0) AS before
  FROM d)
SELECT day_start, changes, CASE WHEN before > 0 THEN """ + ev.sql_round("((changes - before)::DOUBLE / before * 100)", 1)
       + " ELSE 100.0::DOUBLE END AS change FROM c")
def _(spark, sf):
    changes = _events(spark, sf).filter(F.col("event_type").isin("view", "click")).withColumnRenamed(
        "ts", "detected_at")
    written = runs.drain(st.changes_per_day(changes), "changes-per-day", mode="update")
    days = latest_per_key(written, ["day_start"], "batch").drop("batch")
    return st.compare_days(days).select(
        F.col("day_start").cast("timestamp_ntz").alias("day_start"), "changes", "change")


@query("scan_progress", """
WITH p AS (SELECT l_suppkey AS scan_id, count(*) AS pages_crawled,
  last('/p/' || l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS current_url FROM lineitem GROUP BY 1)
SELECT p.scan_id, pages_crawled, current_url, least(100, CAST(trunc(pages_crawled * 100.0 / total) AS INTEGER)) AS progress
FROM p JOIN (SELECT s_suppkey AS scan_id, 500 + CAST(s_nationkey AS INTEGER) * 10 AS total FROM supplier) t ON t.scan_id = p.scan_id""")
def _(spark, sf):
    crawled = _lines(spark, sf, _shares("l_orderkey"), CRAWLED).selectExpr(
        "l_suppkey AS scan_id", "concat('/p/', l_partkey) AS url", "l_shipdate AS crawled_at", "l_orderkey",
        "l_linenumber", "l_partkey")
    totals = ev.raw(spark, sf, "supplier").selectExpr("s_suppkey AS scan_id", "500 + s_nationkey * 10 AS total")
    written = runs.drain(st.scan_progress(crawled, totals, tie=("l_orderkey", "l_linenumber", "l_partkey")),
                         "scan-progress", mode="update")
    return latest_per_key(written, ["scan_id"], "batch").drop("batch")


@query("dedupe_pages", "SELECT DISTINCT l_suppkey AS scan_id, '/p/' || l_partkey AS url FROM lineitem")
def _(spark, sf):
    crawled = _lines(spark, sf, _shares("l_orderkey"), CRAWLED).selectExpr(
        "l_suppkey AS scan_id", "concat('/p/', l_partkey) AS url", "l_shipdate AS crawled_at")
    return runs.drain(st.dedupe_pages(crawled), "dedupe-pages").select("scan_id", "url")


@query("dedupe_pages_stored", """
SELECT DISTINCT CASE WHEN l_suppkey % 50 > 0 THEN l_suppkey END AS scan_id, '/p/' || l_partkey AS url FROM lineitem""")
def _(spark, sf):
    # Some pages belong to no scan.
    crawled = _lines(spark, sf, _shares("l_orderkey"), CRAWLED).selectExpr(
        "CASE WHEN l_suppkey % 50 > 0 THEN l_suppkey END AS scan_id", "concat('/p/', l_partkey) AS url",
        "l_shipdate AS crawled_at")
    base = scratch_dir(spark, "dedupe-stored")
    seen = SeenTable(spark, f"{base}/seen", crawled.select("scan_id", "url").schema, buckets=max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dedupe_stored(crawled, seen, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out/*").select("scan_id", "url")


@query("route_alerts", r"""
SELECT CASE event_type WHEN 'view' THEN 'scans' WHEN 'error' THEN 'alerts' ELSE 'competitors' END AS channel,
  count(*) AS messages, CAST(sum(user_id) AS BIGINT) AS user_sum FROM events WHERE event_type IN ('view', 'error', 'signup') GROUP BY 1""")
def _(spark, sf):
    events = _events(spark, sf).select(
        F.when(F.col("event_type") == "view", "scan_progress").when(F.col("event_type") == "error", "new_alert")
        .when(F.col("event_type") == "signup", "competitor_update").otherwise("other").alias("kind"),
        F.struct("user_id", "value").alias("data"))
    base = scratch_dir(spark, "routed")
    runs.route_alerts(events, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    routed = spark.read.parquet(f"{base}/out")
    user = F.get_json_object("message", "$.data.user_id").cast("bigint")
    return routed.groupBy("channel").agg(F.count(F.lit(1)).alias("messages"), F.sum(user).alias("user_sum"))

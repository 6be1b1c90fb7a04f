"""Queries: prices, content and product changes, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import prices as px
from marketlens.functions import text as tx
from marketlens.functions.arrays import unnest
from marketlens.operators import changes as ch
from marketlens.operators import prices as pr
from marketlens.plans import entity_views as ev
from marketlens.plans.registry import query
from marketlens.session import scratch_dir
from marketlens.sources.state_table import StateTable

TIE = ("order_key", "line_number", "price")
_ORDER = "captured_at, order_key, line_number, price"
_NEWEST = "captured_at DESC, order_key DESC, line_number DESC, price DESC"


def _half_even(scale: int) -> str:
    """Percent change of cents, rounded half to even with integers only."""
    n = f"(abs(nc - oc) * {100 * 10 ** scale})"
    return (f"(CASE WHEN nc < oc THEN -1 ELSE 1 END * ({n} // oc + CASE WHEN 2 * ({n} % oc) > oc OR "
            f"(2 * ({n} % oc) = oc AND ({n} // oc) % 2 = 1) THEN 1 ELSE 0 END))")


_CHANGES_SQL = f"""
WITH linked AS (
  SELECT *, lag(price) OVER (PARTITION BY competitor_id, product_name ORDER BY {_ORDER}) AS old_price
  FROM price_history),
cents AS (SELECT *, CAST(price * 100 AS BIGINT) AS nc, CAST(old_price * 100 AS BIGINT) AS oc FROM linked),
price_changes AS (
  SELECT *, CASE WHEN oc IS NULL THEN 'new' WHEN oc = nc OR abs(nc - oc) * 100 < oc THEN 'unchanged'
    WHEN nc > oc THEN 'increase' ELSE 'decrease' END AS status FROM cents)
"""


def _changes(spark, sf):
    return pr.detect_price_changes(ev.price_history(spark, sf), tie=TIE)


@query("detect_price_changes", _CHANGES_SQL + f"""
SELECT competitor_id, product_name, captured_at, order_key, line_number, price, old_price, status,
  CASE WHEN status IN ('increase', 'decrease')
    THEN CAST(CAST({_half_even(2)} AS DECIMAL(18,2)) / 100 AS DECIMAL(10,2)) END AS change_percentage
FROM price_changes""", "price_history")
def _(spark, sf):
    return _changes(spark, sf).select(
        "competitor_id", "product_name", "captured_at", "order_key", "line_number", "price", "old_price",
        "status", "change_percentage")


_ALERTS_SQL = _CHANGES_SQL + f""",
system_alerts AS (
  SELECT competitor_id, 'price_change' AS alert_type,
    CASE WHEN abs(nc - oc) * 100 > oc * 10 THEN 'high' ELSE 'medium' END AS severity,
    'Price ' || CASE WHEN status = 'increase' THEN 'Increased' ELSE 'Decreased' END || ': '
      || substring(product_name, 1, 50) AS title,
    'Price changed from $' || old_price || ' to $' || price || ' ('
      || CASE WHEN {_half_even(1)} >= 0 THEN '+' ELSE '' END
      || CAST(CAST({_half_even(1)} AS DECIMAL(18,1)) / 10 AS DECIMAL(12,1)) || '%)' AS message,
    product_url AS related_url, captured_at AS created_at
  FROM price_changes WHERE status IN ('increase', 'decrease'))
"""


@query("price_change_alerts", _ALERTS_SQL + """
SELECT c.name AS competitor_name, a.* FROM system_alerts a JOIN competitors c ON c.id = a.competitor_id""",
       "price_history competitors")
def _(spark, sf):
    names = ev.competitors(spark, sf).select(F.col("id").alias("competitor_id"),
                                             F.col("name").alias("competitor_name"))
    return ch.price_change_alerts(_changes(spark, sf)).join(names, "competitor_id")


@query("price_alert_rows", _CHANGES_SQL + f"""
SELECT competitor_id, product_name, old_price, price AS new_price, status AS change_type,
  CASE WHEN status IN ('increase', 'decrease')
    THEN CAST(CAST({_half_even(2)} AS DECIMAL(18,2)) / 100 AS DECIMAL(10,2)) END AS change_percentage,
  product_url AS url, false AS is_read, captured_at AS created_at
FROM price_changes WHERE status <> 'unchanged'""", "price_history")
def _(spark, sf):
    return pr.price_alerts(_changes(spark, sf))


@query("price_change_summary", _CHANGES_SQL + """
SELECT competitor_id, count(*) FILTER (status = 'new') AS new,
  count(*) FILTER (status IN ('increase', 'decrease')) AS updated,
  count(*) FILTER (status = 'unchanged') AS unchanged
FROM price_changes GROUP BY competitor_id""", "price_history")
def _(spark, sf):
    return pr.price_change_summary(_changes(spark, sf), ["competitor_id"])


_LATEST_SQL = f"""
WITH latest AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY competitor_id, product_name ORDER BY {_NEWEST}) AS rn
  FROM price_history) WHERE rn = 1)
"""


def _latest(spark, sf):
    return pr.latest_prices(ev.price_history(spark, sf), tie=TIE)


_LATEST_COLUMNS = ["competitor_id", "product_name", "price", "currency", "original_price",
                   "discount_percent", "is_on_sale", "captured_at"]


@query("latest_prices", _LATEST_SQL + f"SELECT {', '.join(_LATEST_COLUMNS)} FROM latest", "price_history")
def _(spark, sf):
    return _latest(spark, sf).select(*_LATEST_COLUMNS)


@query("price_series", f"""
SELECT competitor_id, product_name, captured_at, price, currency FROM price_history
WHERE captured_at >= TIMESTAMP '{ev.AS_OF_PRICES}' - INTERVAL 30 DAYS""", "price_history")
def _(spark, sf):
    return pr.price_series(ev.price_history(spark, sf), ev.AS_OF_PRICES, days=30)


@query("compare_prices", f"""
SELECT competitor_id, c.name AS competitor_name, product_name, price, currency, is_on_sale, discount_percent
FROM (SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY {_NEWEST}) AS rn
      FROM price_history WHERE product_name ILIKE '%WIDGET%') h
JOIN competitors c ON c.id = h.competitor_id WHERE rn = 1""", "price_history competitors")
def _(spark, sf):
    return pr.compare_prices(ev.price_history(spark, sf), ev.competitors(spark, sf), "WIDGET", tie=TIE)


@query("current_deals", _LATEST_SQL + """
SELECT c.name AS competitor_name, product_name, price, original_price, discount_percent, product_url AS url
FROM latest l JOIN competitors c ON c.id = l.competitor_id WHERE is_on_sale""", "price_history competitors")
def _(spark, sf):
    return pr.current_deals(ev.price_history(spark, sf), ev.competitors(spark, sf), tie=TIE)


@query("recent_price_alerts", _CHANGES_SQL + """
SELECT c.name AS competitor_name, product_name, old_price, price AS new_price, status AS change_type,
  captured_at AS created_at
FROM price_changes p JOIN competitors c ON c.id = p.competitor_id WHERE status <> 'unchanged'
ORDER BY captured_at DESC, c.name DESC, product_name DESC, new_price DESC LIMIT 20""",
       "price_history competitors")
def _(spark, sf):
    newest = pr.recent_price_alerts(pr.price_alerts(_changes(spark, sf)), ev.competitors(spark, sf), 20,
                                    ("competitor_name", "product_name", "new_price"))
    return newest.select("competitor_name", "product_name", "old_price", "new_price", "change_type",
                         "created_at")


@query("price_overview", _LATEST_SQL + """
SELECT competitor_id, count(*) AS products, count(*) FILTER (is_on_sale) AS on_sale,
  sum(price)::DOUBLE / count(*) AS mean_price,
  CAST(floor(count(*) FILTER (is_on_sale) * 100.0::DOUBLE / count(*) + 0.5) AS BIGINT) AS discount_rate
FROM latest GROUP BY competitor_id""", "price_history")
def _(spark, sf):
    return pr.price_overview(_latest(spark, sf), ["competitor_id"])


# --- prices in text ------------------------------------------------------------------------

_OFFER = """CASE p_type WHEN 'ECONOMY' THEN 'Price: $' || {p} || ', save 15%'
  WHEN 'SMALL' THEN {p} || ' EUR each' WHEN 'LARGE' THEN 'from £' || {p} || '/mo, 20% off'
  WHEN 'MEDIUM' THEN '€' || replace({p}, '.', ',') || ' per user'
  WHEN 'STANDARD' THEN 'only $' || p_size || ' or $' || {p} || ' per year'
  ELSE 'starting at $' || {p} || ' with 10% discount' END"""


def _offers(spark, sf):
    """One line of offer text per part, in a wording set by its type."""
    return ev.raw(spark, sf, "part").selectExpr(
        "p_partkey", _OFFER.format(p="CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING)") + " AS offer")


_OFFERS_SQL = f"""offers AS (SELECT p_partkey, {_OFFER.format(
    p="CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)")} AS offer FROM part)"""


def _sql_normalize(x: str) -> str:
    bare = rf"regexp_replace({x}, '[\$€£¥₹\s]', '', 'g')"
    last = f"string_split({bare}, ',')[-1]"
    comma, point = f"instr(reverse({bare}), ',')", f"instr(reverse({bare}), '.')"
    return (f"coalesce(TRY_CAST(CASE WHEN {comma} > 0 AND {point} > 0 AND {comma} < {point} "
            f"THEN replace(replace({bare}, '.', ''), ',', '.') "
            f"WHEN {comma} > 0 AND {point} = 0 AND length({last}) = 2 THEN replace({bare}, ',', '.') "
            f"ELSE replace({bare}, ',', '') END AS DECIMAL(12,2)), 0)::DECIMAL(12,2)")


def _sql_hits(pattern: str) -> str:
    return f"regexp_extract_all(offer, '(?i){pattern}', 1)"


def _sql_values(found: str) -> str:
    return (f", hits AS (SELECT p_partkey, unnest(found) AS raw, generate_subscripts(found, 1) AS i "
            f"FROM (SELECT p_partkey, {found} AS found FROM offers)), "
            f"priced AS (SELECT p_partkey, i, {_sql_normalize('raw')} AS price FROM hits) "
            "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS INTEGER) AS pos, price "
            "FROM priced WHERE price > 0")


@query("extract_price_values", "WITH " + _OFFERS_SQL + _sql_values(
    "CASE " + " ".join(f"WHEN len({_sql_hits(p)}) > 0 THEN {_sql_hits(p)}" for p in px.PRICE_PATTERNS)
    + " ELSE [] END"))
def _(spark, sf):
    return unnest(
        _offers(spark, sf), ["p_partkey"], px.extract_price_values(F.col("offer")), "price", "pos")


@query("extract_price_values_all", "WITH " + _OFFERS_SQL + _sql_values(
    "list_concat(" + ", ".join(_sql_hits(p) for p in px.PRICE_PATTERNS) + ")"))
def _(spark, sf):
    return unnest(
        _offers(spark, sf), ["p_partkey"], px.extract_price_values(F.col("offer"), mode="all"), "price", "pos")


@query("normalize_price", f"""
WITH shown AS (SELECT p_partkey, CASE p_type
  WHEN 'ECONOMY' THEN '$ 1,' || p_retailprice::DECIMAL(12,2) WHEN 'SMALL' THEN '1.234,' || p_size
  WHEN 'LARGE' THEN replace(CAST(p_retailprice::DECIMAL(12,2) AS VARCHAR), '.', ',')
  WHEN 'MEDIUM' THEN '€2,' || (p_size + 100) ELSE 'n/a ' || p_size END AS shown FROM part)
SELECT p_partkey, shown, {_sql_normalize('shown')} AS price FROM shown""")
def _(spark, sf):
    shown = ev.raw(spark, sf, "part").selectExpr(
        "p_partkey",
        "CASE p_type WHEN 'ECONOMY' THEN concat('$ 1,', CAST(p_retailprice AS DECIMAL(12,2))) "
        "WHEN 'SMALL' THEN concat('1.234,', p_size) "
        "WHEN 'LARGE' THEN replace(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING), '.', ',') "
        "WHEN 'MEDIUM' THEN concat('€2,', p_size + 100) ELSE concat('n/a ', p_size) END AS shown")
    return shown.withColumn("price", px.normalize_price(F.col("shown")))


@query("detect_currency", "WITH " + _OFFERS_SQL + " SELECT p_partkey, CASE " + " ".join(
    f"WHEN contains(offer, '{sign}') THEN '{code}'" for sign, code in px.CURRENCIES)
    + " ELSE 'USD' END AS currency FROM offers")
def _(spark, sf):
    return _offers(spark, sf).select("p_partkey", px.detect_currency(F.col("offer")).alias("currency"))


@query("detect_discount", "WITH " + _OFFERS_SQL + " SELECT p_partkey, TRY_CAST(coalesce(" + ", ".join(
    f"nullif(regexp_extract(offer, '(?i){p}', 1), '')" for p in px.DISCOUNT_PATTERNS)
    + ") AS INTEGER) AS discount_percent FROM offers")
def _(spark, sf):
    return _offers(spark, sf).select("p_partkey", px.detect_discount(F.col("offer")).alias("discount_percent"))


@query("sale_from_original", """
SELECT competitor_id, order_key, line_number, product_name, price, original_price,
  CASE WHEN original_price > price THEN CAST(trunc(
    (1.0::DOUBLE - price::DOUBLE / original_price::DOUBLE) * 100) AS INTEGER) END AS saved_percent,
  coalesce(original_price > price, false) AS on_sale
FROM price_history""", "price_history")
def _(spark, sf):
    saved = px.sale_from_original(F.col("price"), F.col("original_price"))
    return ev.price_history(spark, sf).select(
        "competitor_id", "order_key", "line_number", "product_name", "price", "original_price",
        saved.alias("saved_percent"), saved.isNotNull().alias("on_sale"))


# --- content changes -----------------------------------------------------------------------

_CONTENT_SQL = f"""
WITH fresh AS (SELECT *, {ev.sql_content_hash('text_content')} AS new_hash,
    CAST(len({ev.sql_words('text_content')}) AS INTEGER) AS n_words FROM next_contents),
content_diff AS (
  SELECT f.competitor_id, f.url, f.title, f.text_content, f.checked_at, f.new_hash, f.n_words,
    c.content_hash AS old_hash, c.word_count AS old_words, c.text_content AS old_text,
    CASE WHEN length(f.text_content) < 100 THEN 'skipped' WHEN c.url IS NULL THEN 'new'
      WHEN f.new_hash <> c.content_hash THEN 'updated' ELSE 'unchanged' END AS status
  FROM fresh f LEFT JOIN current_contents c ON c.competitor_id = f.competitor_id AND c.url = f.url)
"""


def _content_changes(spark, sf):
    return ch.detect_content_changes(ev.next_contents(spark, sf), ev.current_contents(spark, sf))


@query("detect_content_changes", _CONTENT_SQL + """
SELECT competitor_id, url, status, new_hash, old_hash, n_words AS word_count,
  CASE WHEN status = 'updated' THEN n_words - old_words END AS word_count_change,
  CASE WHEN status = 'updated' THEN old_text END AS old_value,
  CASE WHEN status = 'updated' THEN text_content END AS new_value
FROM content_diff""", "next_contents current_contents")
def _(spark, sf):
    return _content_changes(spark, sf).select(
        "competitor_id", "url", "status", "new_hash", "old_hash", "word_count", "word_count_change",
        "old_value", "new_value")


@query("content_change_log", _CONTENT_SQL + """
SELECT competitor_id, url, 'modified' AS change_type, 'content' AS field_changed,
  old_text AS old_value, text_content AS new_value,
  old_hash, new_hash, n_words - old_words AS word_count_change, checked_at AS detected_at
FROM content_diff WHERE status = 'updated'""", "next_contents current_contents")
def _(spark, sf):
    return ch.content_change_log(_content_changes(spark, sf))


_NEXT_STATE_SQL = _CONTENT_SQL + f""",
seen AS (SELECT * FROM content_diff WHERE status <> 'skipped')
SELECT coalesce(s.competitor_id, c.competitor_id) AS competitor_id, coalesce(s.url, c.url) AS url,
  CASE WHEN s.status = 'new' THEN s.title ELSE c.title END AS title,
  CASE WHEN s.status IN ('new', 'updated') THEN s.text_content ELSE c.text_content END AS text_content,
  coalesce(s.new_hash, c.content_hash) AS content_hash,
  CASE WHEN s.status = 'updated' THEN s.old_hash END AS previous_hash,
  coalesce(s.status = 'updated', c.has_changed) AS has_changed,
  coalesce(s.n_words, c.word_count) AS word_count,
  CASE WHEN s.status IN ('new', 'updated') THEN {ev.sql_readability("coalesce(s.text_content, '')")}
    ELSE c.readability_score END AS readability_score,
  CASE WHEN s.status = 'new' THEN {ev.sql_category('s.url', 's.title')} ELSE c.content_type END AS content_type,
  coalesce(c.first_seen, s.checked_at) AS first_seen, coalesce(s.checked_at, c.last_checked) AS last_checked
FROM seen s FULL JOIN current_contents c ON c.competitor_id = s.competitor_id AND c.url = s.url"""
_STATE_COLUMNS = ["competitor_id", "url", "title", "text_content", "content_hash", "previous_hash", "has_changed", "word_count",
                  "readability_score", "content_type", "first_seen", "last_checked"]


# A stored text is the one that its keywords were taken from; they are counted once for equal texts.
@query("apply_content_changes", f"""
WITH state AS ({_NEXT_STATE_SQL}),
worded AS (SELECT sha256(body) AS body_key, list_filter({ev.sql_ascii_words('body')},
  lambda w: NOT list_contains({ev.sql_list(tx.KEYWORD_STOP_WORDS)}, w)) AS tokens
  FROM (SELECT DISTINCT text_content AS body FROM state)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body_key ORDER BY n DESC, pos) AS place
  FROM ({ev.sql_token_counts('worded', 'body_key', 'tokens')})),
listed AS (SELECT body_key, '["' || string_agg(token, '","' ORDER BY place) || '"]' AS words
  FROM ranked WHERE place <= 10 GROUP BY body_key)
SELECT state.*, coalesce(words, '[]') AS keywords FROM state LEFT JOIN listed ON body_key = sha256(text_content)""",
       "next_contents current_contents")
def _(spark, sf):
    return ch.apply_content_changes(ev.next_contents(spark, sf), ev.current_contents(spark, sf)).select(
        *_STATE_COLUMNS, "keywords")


@query("apply_content_deltas", _NEXT_STATE_SQL, "next_contents current_contents")
def _(spark, sf):
    # The crawl in three parts, each written as a delta of the rows that it touches.
    base, crawl = ev.current_contents(spark, sf), ev.next_contents(spark, sf)
    state = StateTable(spark, scratch_dir(spark, "contents"), ch.apply_content_changes(crawl, base).schema,
                       ["competitor_id", "url"], buckets=8)
    # A crawl without pages brings the base to the columns of the state.
    state.upsert(ch.apply_content_changes(crawl.limit(0), base), 0)
    for part in range(3):
        pages = crawl.filter(F.pmod(F.hash("url"), F.lit(3)) == part)
        state.upsert(ch.apply_content_changes(pages, state.lookup(pages)), part + 1)
    return state.current().select(_STATE_COLUMNS)


@query("text_word_delta", """
SELECT host_key, page_key, scan_id, page, crawled_at, word_count,
  word_count - lag(word_count) OVER (PARTITION BY host_key, page_key
    ORDER BY crawled_at, scan_id, page, word_count) AS word_count_change
FROM scan_pages""", "scan_pages")
def _(spark, sf):
    snapshots = ev.scan_pages(spark, sf)
    return ch.word_deltas(snapshots, ["host_key", "page_key"], "crawled_at",
                          ("scan_id", "page", "word_count")).select(
        "host_key", "page_key", "scan_id", "page", "crawled_at", "word_count", "word_count_change")


# --- product changes -----------------------------------------------------------------------

_CARDS_SQL = """
WITH known AS (SELECT * FROM products WHERE category <> 'PROMO'),
cards AS (SELECT competitor_id, name, url, is_available AND category <> 'LARGE' AS is_available,
    CASE WHEN category = 'SMALL' THEN description || ' (new)' ELSE description END AS description,
    last_checked AS checked_at FROM products),
product_diff AS (
  SELECT n.*, k.name IS NULL AS is_fresh, k.is_available AS was_available,
    CASE WHEN k.name IS NULL THEN 'new' WHEN sha256(coalesce(n.description, '')) <> sha256(coalesce(k.description, ''))
      OR n.is_available <> k.is_available THEN 'updated' ELSE 'unchanged' END AS status,
    coalesce(k.was, false) AND NOT n.is_available AS went_unavailable
  FROM cards n LEFT JOIN (SELECT *, is_available AS was FROM known) k
    ON k.competitor_id = n.competitor_id AND k.name = n.name)
"""


def product_cards(spark, sf):
    """The following capture of the catalog: some texts edited, one category out of stock."""
    return ev.products(spark, sf).selectExpr(
        "competitor_id", "name", "url", "is_available AND category <> 'LARGE' AS is_available",
        "CASE WHEN category = 'SMALL' THEN concat(description, ' (new)') ELSE description END AS description",
        "last_checked AS checked_at")


def known_products(spark, sf):
    return ev.products(spark, sf).filter("category <> 'PROMO'")


def _product_changes(spark, sf):
    return ch.detect_product_changes(product_cards(spark, sf), known_products(spark, sf))


@query("detect_product_changes", _CARDS_SQL + """
SELECT competitor_id, name, status, went_unavailable, sha256(coalesce(description, '')) AS description_hash
FROM product_diff""", "products")
def _(spark, sf):
    return _product_changes(spark, sf).select("competitor_id", "name", "status", "went_unavailable",
                                              "description_hash")


@query("product_change_summary", _CARDS_SQL + """
SELECT competitor_id, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'updated') AS updated,
  count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (went_unavailable) AS unavailable
FROM product_diff GROUP BY competitor_id""", "products")
def _(spark, sf):
    return ch.product_change_summary(_product_changes(spark, sf), ["competitor_id"])


@query("emit_alerts", _ALERTS_SQL + ", " + _CONTENT_SQL.strip()[5:] + ", " + _CARDS_SQL.strip()[5:] + """
SELECT * FROM system_alerts
UNION ALL
SELECT competitor_id, CASE status WHEN 'updated' THEN 'content_update' ELSE 'new_page' END,
  CASE status WHEN 'updated' THEN 'medium' ELSE 'low' END,
  CASE status WHEN 'updated' THEN 'Content Updated: ' ELSE 'New Page Discovered: ' END || substring(title, 1, 50),
  CASE status WHEN 'updated' THEN 'The page at ' || url || ' has been modified'
    ELSE 'A new page has been found at ' || url END, url, checked_at
FROM content_diff WHERE status IN ('new', 'updated')
UNION ALL
SELECT competitor_id, CASE status WHEN 'new' THEN 'new_product' ELSE 'availability_change' END,
  CASE status WHEN 'new' THEN 'high' ELSE 'medium' END,
  CASE status WHEN 'new' THEN 'New Product: ' ELSE 'Product Unavailable: ' END || substring(name, 1, 50),
  CASE status WHEN 'new' THEN 'Competitor launched a new product' ELSE 'Product is now out of stock' END,
  url, checked_at
FROM product_diff WHERE status = 'new' OR went_unavailable""",
       "price_history next_contents current_contents products")
def _(spark, sf):
    return ch.emit_alerts(_changes(spark, sf), _content_changes(spark, sf), _product_changes(spark, sf))


# --- state updates -------------------------------------------------------------------------


@query("acknowledge", """
WITH acks AS (SELECT o_custkey AS alert_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'dismiss' ELSE 'read' END AS action, o_orderdate AS acted_at FROM orders),
per_alert AS (SELECT alert_id, bool_or(action = 'read') AS r, bool_or(action = 'dismiss') AS d,
    min(acted_at) FILTER (action = 'read') AS first_read FROM acks GROUP BY alert_id)
SELECT id, is_read OR coalesce(r, false) AS is_read, is_dismissed OR coalesce(d, false) AS is_dismissed,
  CASE WHEN r AND NOT is_read THEN first_read END AS read_at
FROM alerts LEFT JOIN per_alert ON alert_id = id""", "alerts")
def _(spark, sf):
    acks = ev.raw(spark, sf, "orders").selectExpr(
        "o_custkey AS alert_id", "CASE o_orderpriority WHEN '1-URGENT' THEN 'dismiss' ELSE 'read' END AS action",
        "o_orderdate AS at")
    return ch.acknowledge(ev.alerts(spark, sf), acks).select("id", "is_read", "is_dismissed", "read_at")


@query("upsert_competitors", """
WITH incoming AS (SELECT s_suppkey + 1000000000 AS id,
    CASE WHEN s_acctbal < 0 THEN 'https://new' ELSE 'https://site' END || s_suppkey || '.example.com/' AS url,
    CASE WHEN s_nationkey < 12 THEN s_name END AS name, 'Wholesale' AS industry,
    s_acctbal > 9000 AS is_deleted FROM supplier)
SELECT coalesce(c.id, i.id) AS id, coalesce(c.url, i.url) AS url, coalesce(i.name, c.name) AS name,
  coalesce(i.industry, c.industry) AS industry,
  coalesce(c.is_active, true) AND NOT coalesce(i.is_deleted, false) AS is_active,
  CASE WHEN c.url IS NULL THEN 'inserted' WHEN i.url IS NULL THEN 'kept' ELSE 'patched' END AS outcome
FROM competitors c FULL JOIN incoming i ON i.url = c.url""", "competitors")
def _(spark, sf):
    incoming = ev.raw(spark, sf, "supplier").selectExpr(
        "s_suppkey + 1000000000 AS id",
        "concat(CASE WHEN s_acctbal < 0 THEN 'https://new' ELSE 'https://site' END, s_suppkey, "
        "'.example.com/') AS url",
        "CASE WHEN s_nationkey < 12 THEN s_name END AS name", "'Wholesale' AS industry",
        "s_acctbal > 9000 AS is_deleted")
    return ch.upsert_competitors(ev.competitors(spark, sf), incoming, ["name", "industry"])

"""Entity tables seen through the given benchmark tables.

Each view has a Spark form and a DuckDB form with the same rows, so a query and
its check start from the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import text as tx
from marketlens.sources.tables import dealt, spread

# Newest instants of the given tables; relative queries are run as of these.
AS_OF_EVENTS = "2024-01-30 12:00:00"
AS_OF_PRICES = "2001-11-05 00:00:00"
AS_OF_SCANS = "2001-08-02 00:00:00"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows carry long texts or become pages."""
    return spread(raw(spark, sf_dir, name))


def competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name",
        "concat('https://site', c_custkey, '.example.com/') AS url",
        "concat('site', c_custkey, '.example.com') AS domain",
        "CASE WHEN c_nationkey < 12 THEN 'direct' ELSE 'indirect' END AS competitor_type",
        "c_mktsegment AS industry",
        "CAST(floor((c_acctbal + 1000) / 110) AS INT) AS seo_score",
        "CAST(c_nationkey * 4 AS INT) AS content_score",
        "CAST(floor(abs(c_acctbal) / 100) AS INT) AS health_score",
        "c_acctbal >= 0 AS is_active", "c_acctbal < 8000 AS is_monitoring",
        "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, CAST(c_custkey AS INT)) AS created_at",
    )


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = raw(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return heavy(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "l_suppkey AS competitor_id", "l_partkey AS product_id",
        "concat(p_name, ' ', l_partkey) AS product_name",
        "concat('/products/', l_partkey) AS product_url",
        "CAST(l_extendedprice AS DECIMAL(12,2)) AS price", "'USD' AS currency",
        "CASE WHEN l_discount >= 0.05 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) "
        "+ CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(12,2)) END AS original_price",
        "CAST(round(l_discount * 100) AS INT) AS discount_percent",
        "l_discount >= 0.05 AS is_on_sale", "l_shipdate AS captured_at",
        "l_orderkey AS order_key", "l_linenumber AS line_number",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = raw(spark, sf_dir, "part")
    seen = raw(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_checked"))
    return seen.join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "concat(l_suppkey, '-', l_partkey) AS id", "l_suppkey AS competitor_id", "l_partkey AS part_key",
        "concat(p_name, ' ', l_partkey) AS name", "concat('/products/', l_partkey) AS url",
        "concat('Made by ', p_brand) AS description", "p_type AS category",
        "concat('/img/', l_partkey, '.png') AS image_url", "p_size > 5 AS is_available",
        "first_seen = last_checked AS is_new", "first_seen", "last_checked",
    )


def product_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lines = raw(spark, sf_dir, "part"), raw(spark, sf_dir, "lineitem")
    # No more pairs than lines, whose number stands in the files' footers.
    pairs = dealt(lines.select("l_suppkey", "l_partkey").distinct(), lines.count(), "l_partkey")
    return pairs.join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "concat(l_suppkey, '-', l_partkey) AS product_id", "l_suppkey AS competitor_id",
        "concat(p_brand, ' ', p_size) AS feature_name", "nullif(p_type, 'SMALL') AS feature_value",
        "CASE WHEN p_size < 25 THEN 'general' ELSE 'specification' END AS feature_category",
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS competitor_id",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status",
        "CASE o_orderstatus WHEN 'F' THEN 100 ELSE 40 END AS progress",
        "CAST(floor(o_totalprice / 1000) AS INT) AS pages_crawled",
        "CAST(floor(o_totalprice / 1000) AS INT) + 10 AS pages_discovered",
        "concat('https://site', o_custkey, '.example.com/', o_orderkey) AS current_url",
        "o_orderdate AS started_at", "o_orderdate AS created_at",
        "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + make_dt_interval(0, 0, 0, "
        "CAST(floor(o_totalprice / 1000) AS INT) * 3) END AS completed_at",
    )


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS scan_id", "l_linenumber AS page", "l_suppkey AS host_key", "l_partkey AS page_key",
        "concat('https://site', l_suppkey, '.example.com/p/', l_partkey) AS url",
        "CAST(l_quantity AS INT) AS word_count", "l_shipdate AS crawled_at",
    )


_K = "CAST(get_json_object(props, '$.k') AS INT)"


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id AS competitor_id", "event_type AS alert_type",
        "CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'medium' WHEN value < 150 THEN 'high' "
        "ELSE 'critical' END AS severity",
        "concat(event_type, ' on site ', user_id) AS title", "props AS message",
        f"{_K} < 30 AS is_read", f"{_K} >= 90 AS is_dismissed", "ts AS created_at",
    )


def content_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click")).selectExpr(
        "event_id AS id", "user_id AS content_id", "event_type AS change_type",
        "'content' AS field_changed", "props AS old_value", "concat('next ', props) AS new_value",
        "ts AS detected_at",
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = heavy(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "CAST(substring(source, 4) AS BIGINT) AS competitor_id",
        "concat('https://', source, '.example.com/', lang, '/', doc_id) AS url",
        "text AS title", "text AS text_content", "lang", "lang = 'de' AS has_changed",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT)) AS last_checked",
    )
    text = F.col("text_content")
    return base.select(
        "*",
        tx.content_category(F.concat(F.col("url"), F.lit("/page")), F.col("title")).alias("content_type"),
        tx.word_count(text).alias("word_count"),
        tx.readability(text).alias("readability_score"),
        tx.content_hash(text).alias("content_hash"),
        F.to_json(tx.top_keywords(text)).alias("keywords"),
    )


def next_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The following crawl: German pages were edited, Spanish pages are seen for the first time."""
    return heavy(spark, sf_dir, "documents").selectExpr(
        "CAST(substring(source, 4) AS BIGINT) AS competitor_id",
        "concat('https://', source, '.example.com/', lang, '/', doc_id) AS url",
        "text AS title",
        "CASE WHEN lang = 'de' THEN concat(text, ' Neu im Angebot.') ELSE text END AS text_content",
        "timestamp_ntz'2024-02-01 00:00:00' AS checked_at",
    )


def current_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored state before that crawl."""
    return contents(spark, sf_dir).filter("lang <> 'es'").withColumn("first_seen", F.col("last_checked"))


def seo_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    def scored(name: str, factor: int) -> str:
        return f"CAST((event_id * {factor} + user_id * 11) % 101 AS INT) AS {name}"

    def counted(name: str, modulus: int) -> str:
        return f"CAST(event_id % {modulus} AS INT) AS {name}"

    return raw(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id AS competitor_id", "ts AS analyzed_at",
        "concat('https://site', user_id, '.example.com/') AS url",
        scored("overall_score", 37), scored("title_score", 13), scored("meta_description_score", 17),
        scored("headers_score", 19), scored("content_score", 23), scored("technical_score", 29),
        scored("images_score", 31), scored("links_score", 41), scored("page_speed_score", 43),
        "CASE WHEN value >= 3 THEN concat('Page about ', event_type) END AS title",
        counted("title_length", 90),
        "CASE WHEN value >= 2 THEN concat('All on ', event_type) END AS meta_description",
        counted("meta_description_length", 220), counted("h1_count", 3), counted("h2_count", 4),
        counted("h3_count", 5), counted("word_count", 2500), counted("images_count", 7),
        "CAST(least(event_id % 7, event_id % 5) AS INT) AS images_with_alt",
        counted("internal_links", 12), counted("external_links", 6),
        f"{_K} > 10 AS has_ssl", f"{_K} > 30 AS has_sitemap", f"{_K} > 50 AS has_robots",
        f"{_K} > 20 AS has_canonical", f"{_K} > 60 AS has_schema",
        "CASE WHEN value > 300 THEN 'no json' ELSE concat('{\"', event_type, '\": 2.5, \"topic', "
        f"event_id % 50, '\": 1.2, \"Key', {_K}, '\": 0.5}}') END AS keyword_density",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy(spark, sf_dir, "pages")


# --- the same views for DuckDB -------------------------------------------------------------

_SQL_K = r"CAST(regexp_extract(props, '\d+') AS INTEGER)"
SQL_WS = r"\t-\r\x1c-\x20\x{85}\p{Z}"


def _scored(name: str, factor: int) -> str:
    return f"CAST((event_id * {factor} + user_id * 11) % 101 AS INTEGER) AS {name}"


def _counted(name: str, modulus: int) -> str:
    return f"CAST(event_id % {modulus} AS INTEGER) AS {name}"


def sql_words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{SQL_WS}]+')"


def sql_round(value: str, digits: int) -> str:
    """Half-even rounding of a double by its decimal digits; the plain function first scales in binary."""
    return f"round_even(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,18)), {digits})::DOUBLE"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SQL_WS}]+|[{SQL_WS}]+$', '', 'g')"


def sql_content_hash(text: str) -> str:
    return f"sha256(regexp_replace(lower({sql_strip(text)}), '[{SQL_WS}]+', ' ', 'g'))"


def sql_ascii_words(text: str) -> str:
    """Runs of word characters that are made of ASCII letters only, at least three of them."""
    return (rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'), "
            "lambda w: regexp_full_match(w, '[a-z]{3,}'))")


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_token_counts(source: str, key: str, tokens: str) -> str:
    """(key, token, n, pos) rows: counts and first positions of an array column."""
    return (f"SELECT {key}, token, count(*) AS n, min(pos) AS pos FROM ("
            f"SELECT {key}, unnest({tokens}) AS token, generate_subscripts({tokens}, 1) AS pos FROM {source}"
            f") GROUP BY {key}, token")


def sql_readability(text: str) -> str:
    words = sql_words(text)
    groups = "len(regexp_extract_all(lower(w), '[aeiouy]+'))"
    spoken = (f"list_sum(list_transform({words}, lambda w: greatest(1, {groups} - "
              f"CASE WHEN {groups} > 1 AND ends_with(lower(w), 'e') THEN 1 ELSE 0 END)))")
    sentences = (f"len(list_filter(regexp_split_to_array({text}, '[.!?]+'), "
                 f"lambda s: regexp_matches(s, '[^{SQL_WS}]')))")
    return (f"CASE WHEN len({words}) = 0 OR {sentences} = 0 THEN 0.0::DOUBLE ELSE "
            f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE "
            f"- 1.015::DOUBLE * (len({words})::DOUBLE / {sentences}::DOUBLE) "
            f"- 84.6::DOUBLE * ({spoken}::DOUBLE / len({words})::DOUBLE))) END")


def sql_category(url: str, title: str) -> str:
    def any_in(col: str, parts: list[str]) -> str:
        return "(" + " OR ".join(f"contains({col}, '{p}')" for p in parts) + ")"

    low, name = f"lower({url})", f"lower(coalesce({title}, ''))"
    cases = [f"WHEN {any_in(low, parts)} THEN '{label}'" for label, parts in tx.CATEGORY_URL_PARTS]
    cases.append(f"WHEN ends_with({low}, '/') OR length({low}) - length(replace({low}, '/', '')) <= 3 "
                 "THEN 'landing'")
    cases += [f"WHEN {any_in(name, parts)} THEN '{label}'" for label, parts in tx.CATEGORY_TITLE_WORDS]
    return "CASE " + " ".join(cases) + " ELSE 'other' END"


SQL_VIEWS: dict[str, str] = {
    "competitors": """
        SELECT c_custkey AS id, c_name AS name, 'https://site' || c_custkey || '.example.com/' AS url,
          'site' || c_custkey || '.example.com' AS domain,
          CASE WHEN c_nationkey < 12 THEN 'direct' ELSE 'indirect' END AS competitor_type,
          c_mktsegment AS industry, CAST(floor((c_acctbal + 1000) / 110) AS INTEGER) AS seo_score,
          CAST(c_nationkey * 4 AS INTEGER) AS content_score,
          CAST(floor(abs(c_acctbal) / 100) AS INTEGER) AS health_score,
          c_acctbal >= 0 AS is_active, c_acctbal < 8000 AS is_monitoring,
          TIMESTAMP '2020-01-01 00:00:00' + to_minutes(c_custkey) AS created_at
        FROM customer""",
    "price_history": """
        SELECT l_suppkey AS competitor_id, l_partkey AS product_id, p_name || ' ' || l_partkey AS product_name,
          '/products/' || l_partkey AS product_url, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
          'USD' AS currency,
          CASE WHEN l_discount >= 0.05 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2))
            + CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(12,2)) END AS original_price,
          CAST(round(l_discount * 100) AS INTEGER) AS discount_percent,
          l_discount >= 0.05 AS is_on_sale, l_shipdate AS captured_at,
          l_orderkey AS order_key, l_linenumber AS line_number
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "products": """
        SELECT l_suppkey || '-' || l_partkey AS id, l_suppkey AS competitor_id, l_partkey AS part_key,
          p_name || ' ' || l_partkey AS name, '/products/' || l_partkey AS url,
          'Made by ' || p_brand AS description, p_type AS category,
          '/img/' || l_partkey || '.png' AS image_url, p_size > 5 AS is_available,
          first_seen = last_checked AS is_new, first_seen, last_checked
        FROM (SELECT l_suppkey, l_partkey, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_checked
              FROM lineitem GROUP BY l_suppkey, l_partkey) s JOIN part ON l_partkey = p_partkey""",
    "product_features": """
        SELECT l_suppkey || '-' || l_partkey AS product_id, l_suppkey AS competitor_id,
          p_brand || ' ' || p_size AS feature_name, nullif(p_type, 'SMALL') AS feature_value,
          CASE WHEN p_size < 25 THEN 'general' ELSE 'specification' END AS feature_category
        FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) s JOIN part ON l_partkey = p_partkey""",
    "scans": """
        SELECT o_orderkey AS id, o_custkey AS competitor_id,
          CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
          CASE o_orderstatus WHEN 'F' THEN 100 ELSE 40 END AS progress,
          CAST(floor(o_totalprice / 1000) AS INTEGER) AS pages_crawled,
          CAST(floor(o_totalprice / 1000) AS INTEGER) + 10 AS pages_discovered,
          'https://site' || o_custkey || '.example.com/' || o_orderkey AS current_url,
          o_orderdate AS started_at, o_orderdate AS created_at,
          CASE WHEN o_orderstatus = 'F' THEN o_orderdate
            + to_seconds(CAST(floor(o_totalprice / 1000) AS INTEGER) * 3) END AS completed_at
        FROM orders""",
    "scan_pages": """
        SELECT l_orderkey AS scan_id, l_linenumber AS page, l_suppkey AS host_key, l_partkey AS page_key,
          'https://site' || l_suppkey || '.example.com/p/' || l_partkey AS url,
          CAST(l_quantity AS INTEGER) AS word_count, l_shipdate AS crawled_at
        FROM lineitem""",
    "alerts": f"""
        SELECT event_id AS id, user_id AS competitor_id, event_type AS alert_type,
          CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'medium' WHEN value < 150 THEN 'high'
            ELSE 'critical' END AS severity,
          event_type || ' on site ' || user_id AS title, props AS message,
          {_SQL_K} < 30 AS is_read, {_SQL_K} >= 90 AS is_dismissed, ts AS created_at
        FROM events""",
    "content_changes": """
        SELECT event_id AS id, user_id AS content_id, event_type AS change_type, 'content' AS field_changed,
          props AS old_value, 'next ' || props AS new_value, ts AS detected_at
        FROM events WHERE event_type IN ('view', 'click')""",
    "content_base": """
        SELECT doc_id AS id, CAST(substring(source, 4) AS BIGINT) AS competitor_id,
          'https://' || source || '.example.com/' || lang || '/' || doc_id AS url,
          text AS title, text AS text_content, lang, lang = 'de' AS has_changed,
          TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS last_checked
        FROM documents""",
    "contents": f"""
        SELECT *, {sql_category("url || '/page'", 'title')} AS content_type,
          CAST(len({sql_words('text_content')}) AS INTEGER) AS word_count,
          {sql_readability('text_content')} AS readability_score,
          {sql_content_hash('text_content')} AS content_hash
        FROM content_base""",
    "content_keywords": f"""
        SELECT id, token AS keyword, pos_rank - 1 AS keyword_pos FROM (
          SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY n DESC, pos) AS pos_rank FROM ({
            sql_token_counts("(SELECT id, list_filter(" + sql_ascii_words("text_content")
                             + ", lambda w: NOT list_contains(" + sql_list(tx.KEYWORD_STOP_WORDS)
                             + ", w)) AS tokens FROM content_base)", "id", "tokens")}))
        WHERE pos_rank <= 10""",
    "next_contents": """
        SELECT CAST(substring(source, 4) AS BIGINT) AS competitor_id,
          'https://' || source || '.example.com/' || lang || '/' || doc_id AS url,
          text AS title,
          CASE WHEN lang = 'de' THEN text || ' Neu im Angebot.' ELSE text END AS text_content,
          TIMESTAMP '2024-02-01 00:00:00' AS checked_at
        FROM documents""",
    "current_contents": "SELECT *, last_checked AS first_seen FROM contents WHERE lang <> 'es'",
    "seo_analyses": f"""
        SELECT event_id AS id, user_id AS competitor_id, ts AS analyzed_at,
          'https://site' || user_id || '.example.com/' AS url,
          {_scored("overall_score", 37)}, {_scored("title_score", 13)},
          {_scored("meta_description_score", 17)}, {_scored("headers_score", 19)},
          {_scored("content_score", 23)}, {_scored("technical_score", 29)},
          {_scored("images_score", 31)}, {_scored("links_score", 41)}, {_scored("page_speed_score", 43)},
          CASE WHEN value >= 3 THEN 'Page about ' || event_type END AS title,
          {_counted("title_length", 90)},
          CASE WHEN value >= 2 THEN 'All on ' || event_type END AS meta_description,
          {_counted("meta_description_length", 220)}, {_counted("h1_count", 3)}, {_counted("h2_count", 4)},
          {_counted("h3_count", 5)}, {_counted("word_count", 2500)}, {_counted("images_count", 7)},
          CAST(least(event_id % 7, event_id % 5) AS INTEGER) AS images_with_alt,
          {_counted("internal_links", 12)}, {_counted("external_links", 6)},
          {_SQL_K} > 10 AS has_ssl, {_SQL_K} > 30 AS has_sitemap, {_SQL_K} > 50 AS has_robots,
          {_SQL_K} > 20 AS has_canonical, {_SQL_K} > 60 AS has_schema,
          value <= 300 AS has_keywords, event_type AS keyword_1, 'topic' || event_id % 50 AS keyword_2,
          'Key' || {_SQL_K} AS keyword_3
        FROM events""",
}
_NEEDS = {"contents": ["content_base"], "content_keywords": ["content_base"],
          "current_contents": ["contents"]}


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the named views (space separated) as CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = [f"{n} AS ({SQL_VIEWS[n]})" for n in ordered]
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body

"""Queries: urls, frontier, site files, text and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import text as tx
from marketlens.functions import urls
from marketlens.functions.arrays import ngrams, unnest
from marketlens.operators import fingerprints as fp
from marketlens.operators import frontier as fr
from marketlens.plans import entity_views as ev
from marketlens.plans.registry import query
from marketlens.session import scratch_dir
from marketlens.sources import site_files

_URI = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _sql_part(url: str, i: int) -> str:
    return f"regexp_extract({url}, '{_URI}', {i})"


def sql_host(url: str) -> str:
    return f"lower({_sql_part(url, 2)})"


def sql_path(url: str) -> str:
    return _sql_part(url, 3)


def sql_normalize(url: str) -> str:
    """Normal form of an absolute url whose parameters need no escaping."""
    low = f"lower({_sql_part(url, 1)})"
    authority = (f"CASE {low} WHEN 'http' THEN regexp_replace({sql_host(url)}, ':80$', '') "
                 f"WHEN 'https' THEN regexp_replace({sql_host(url)}, ':443$', '') ELSE {sql_host(url)} END")
    bare = f"regexp_replace({sql_path(url)}, '(?:/|;[^/;]*)+$', '')"
    path = f"CASE WHEN {bare} = '' THEN '/' ELSE {bare} END"
    pairs = (f"array_to_string(list_sort(list_filter(string_split({_sql_part(url, 4)}, '&'), "
             f"lambda kv: split_part(kv, '=', 2) <> '' AND NOT list_contains({ev.sql_list(urls.TRACKING_PARAMETERS)}, "
             "lower(split_part(kv, '=', 1))))), '&')")
    return f"({low} || '://' || {authority} || {path} || CASE WHEN {pairs} <> '' THEN '?' || {pairs} ELSE '' END)"


def sql_depth(url: str) -> str:
    inner = f"regexp_replace({sql_path(url)}, '^/+|/+$', '', 'g')"
    return f"CASE WHEN {inner} = '' THEN 0 ELSE CAST(len(string_split({inner}, '/')) AS INTEGER) END"


def sql_link_type(url: str) -> str:
    cases = [f"WHEN {' OR '.join(f'contains(lower({url}), {chr(39)}{p}{chr(39)})' for p in parts)} THEN '{label}'"
             for label, parts in urls.LINK_TYPES]
    return "CASE " + " ".join(cases) + " ELSE 'general' END"


def sql_priority(url: str, kind: str | None = None) -> str:
    q = _sql_part(url, 4)
    target = f"lower({sql_path(url)} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"
    cases = [f"WHEN regexp_matches({target}, '{p}') THEN {level}"
             for level, patterns in urls.PRIORITY_PATTERNS for p in patterns]
    if kind:
        cases += [f"WHEN {kind} = '{label}' THEN {level}" for label, level in urls.TYPE_PRIORITIES]
    return "CASE " + " ".join(cases) + f" ELSE {urls.MEDIUM} END"


@query("normalize_url", f"SELECT page_id, url, {sql_normalize('url')} AS normalized FROM pages")
def _(spark, sf):
    return ev.pages(spark, sf).select("page_id", "url", urls.normalize_url(F.col("url")).alias("normalized"))


@query("host_of", f"SELECT page_id, {sql_host('url')} AS host, "
                  f"{sql_host('url')} = 'thther.example.org' AS same FROM pages")
def _(spark, sf):
    return ev.pages(spark, sf).select(
        "page_id", urls.host(F.col("url")).alias("host"),
        urls.same_host(F.col("url"), F.lit("http://THTHER.example.org/x")).alias("same"))


# Public suffixes used where the caller brings no table of them.
SUFFIXES = ["com", "net", "org", "example.com", "io", "co", "de", "fr", "es", "uk", "co.uk"]


@query("registrable_domain", f"""
WITH h AS (SELECT page_id, {sql_host('url')} AS host, string_split({sql_host('url')}, '.') AS labels FROM pages),
tails AS (SELECT page_id, host, labels, unnest(range(1, len(labels))) AS i FROM h),
hits AS (SELECT page_id, min(i) AS i FROM tails
  WHERE list_contains({ev.sql_list(SUFFIXES)}, array_to_string(labels[i + 1:], '.')) GROUP BY page_id)
SELECT h.page_id, host, array_to_string(labels[coalesce(i, len(labels) - 1):], '.') AS domain
FROM h LEFT JOIN hits ON hits.page_id = h.page_id""")
def _(spark, sf):
    suffixes = spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string")
    hosts = ev.pages(spark, sf).select("page_id", urls.host(F.col("url")).alias("host"))
    return fr.registrable_domain(hosts, "host", suffixes)


_RULES = ["com", "net", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "io", "a.b.io"]
_PRIVATE_RULES = ["blogspot.com", "*.apps.io"]
_ENDS = ["com", "shop.co.uk", "uk", "a.ck", "www.ck", "x.www.ck", "ck", "city.kawasaki.jp", "b.kawasaki.jp", "kawasaki.jp",
         "blogspot.com", "me.apps.io", "z.a.b.io", "b.io", "intranet", "COM:8080", "co.uk."]
_RULES_SQL = ", ".join(f"('{r}', {p})" for rules, p in ((_RULES, "false"), (_PRIVATE_RULES, "true")) for r in rules)


def _by_rules_sql(private):
    return f"""
WITH rules(rule, private) AS (VALUES {_RULES_SQL}),
hosts AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN e ELSE 'p' || page_id || '.' || e END AS host
  FROM pages, unnest({ev.sql_list(_ENDS)}) t(e)),
l AS (SELECT page_id, host, list_reverse(string_split(regexp_replace(regexp_replace(lower(host), ':[0-9]*$', ''), '[.]$', ''), '.')) AS labels
  FROM hosts),
names AS (SELECT page_id, host, labels, n, array_to_string(list_reverse(labels[1:n]), '.') AS name
  FROM l, unnest(range(1, len(labels) + 1)) t(n)),
hits AS (SELECT page_id, host, labels, max(CASE WHEN rule = '!' || name THEN n - 1 END) AS e,
    max(CASE WHEN rule = name THEN n WHEN rule = '*.' || name AND n < len(labels) THEN n + 1 END) AS r
  FROM names LEFT JOIN (SELECT rule FROM rules WHERE {"true" if private else "NOT private"}) q
    ON rule IN (name, '*.' || name, '!' || name) GROUP BY ALL)
SELECT page_id, host, CASE WHEN len(labels) > coalesce(e, r, 1)
  THEN array_to_string(list_reverse(labels[1:coalesce(e, r, 1) + 1]), '.') END AS domain FROM hits"""


def _by_rules(spark, sf, private):
    rules = spark.createDataFrame(
        [(r, False) for r in _RULES] + [(r, True) for r in _PRIVATE_RULES], "rule string, private boolean")
    ends = F.explode(F.array(*[F.lit(e) for e in _ENDS]))
    hosts = ev.pages(spark, sf).select("page_id", ends.alias("e")).selectExpr(
        "page_id", "CASE WHEN page_id % 3 = 0 THEN e ELSE concat('p', page_id, '.', e) END AS host")
    return fr.registrable_by_rules(hosts, "host", rules, private)


@query("registrable_by_rules", _by_rules_sql(False))
def _(spark, sf):
    return _by_rules(spark, sf, False)


@query("registrable_by_private_rules", _by_rules_sql(True))
def _(spark, sf):
    return _by_rules(spark, sf, True)


@query("url_depth", f"SELECT page_id, {sql_depth('url')} AS depth FROM pages")
def _(spark, sf):
    return ev.pages(spark, sf).select("page_id", urls.url_depth(F.col("url")).alias("depth"))


# Paths of every class, derived from the part catalog.
_PATHS = ("CASE p_type WHEN 'ECONOMY' THEN '/products/' || p_partkey WHEN 'SMALL' THEN '/Blog/' || p_partkey "
          "WHEN 'LARGE' THEN CASE WHEN p_size < 10 THEN '/' WHEN p_size < 20 THEN '/about/team' "
          "WHEN p_size < 30 THEN '/docs/' || p_partkey WHEN p_size < 40 THEN '/login?next=' || p_partkey "
          "ELSE '/x?page=' || p_size END WHEN 'MEDIUM' THEN '/tag/' || p_partkey "
          "WHEN 'STANDARD' THEN '/pricing' ELSE '/c/' || p_partkey END")
_PART_URLS_SQL = f"part_urls AS (SELECT p_partkey, 'https://shop' || p_size || '.example.com' || {_PATHS} AS url FROM part)"


def part_urls(spark, sf):
    return ev.raw(spark, sf, "part").selectExpr(
        "p_partkey", f"'https://shop' || p_size || '.example.com' || {_PATHS} AS url")


@query("link_type", f"WITH {_PART_URLS_SQL} SELECT p_partkey, url, {sql_link_type('url')} AS link_type FROM part_urls")
def _(spark, sf):
    return part_urls(spark, sf).select("p_partkey", "url", urls.link_type(F.col("url")).alias("link_type"))


@query("crawl_priority", f"""
WITH {_PART_URLS_SQL}, typed AS (SELECT *, {sql_link_type('url')} AS link_type FROM part_urls)
SELECT p_partkey, url, {sql_priority('url', 'link_type')} AS priority FROM typed""")
def _(spark, sf):
    return part_urls(spark, sf).select(
        "p_partkey", "url", urls.crawl_priority(F.col("url"), urls.link_type(F.col("url"))).alias("priority"))


_LINKS_SQL = f"""{_PART_URLS_SQL},
links AS (SELECT l_suppkey AS scan_id, url, l_linenumber AS depth, {sql_priority('url')} AS priority, l_shipdate AS added
  FROM lineitem JOIN part_urls ON l_partkey = p_partkey),
seen AS (SELECT DISTINCT l_suppkey AS scan_id, url FROM lineitem JOIN part_urls ON l_partkey = p_partkey
  WHERE l_returnflag = 'R')"""


def _links(spark, sf):
    lines = ev.raw(spark, sf, "lineitem").join(part_urls(spark, sf), F.col("l_partkey") == F.col("p_partkey"))
    links = lines.select(F.col("l_suppkey").alias("scan_id"), "url", F.col("l_linenumber").alias("depth"),
                         urls.crawl_priority(F.col("url")).alias("priority"), F.col("l_shipdate").alias("added"))
    seen = lines.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("scan_id"), "url").distinct()
    return links, seen


@query("plan_frontier", f"""
WITH {_LINKS_SQL},
firsts AS (SELECT scan_id, url, added, priority, depth FROM (SELECT *, row_number() OVER (
  PARTITION BY scan_id, url ORDER BY added, priority, depth) AS rn FROM links) WHERE rn = 1),
fresh AS (SELECT f.* FROM firsts f ANTI JOIN seen s ON s.scan_id = f.scan_id AND s.url = f.url)
SELECT scan_id, url, added, priority, depth,
  row_number() OVER (PARTITION BY scan_id ORDER BY priority, added, url) AS position FROM fresh""")
def _(spark, sf):
    links, seen = _links(spark, sf)
    return fr.plan_frontier(links, seen)


@query("requeue_failures", """
SELECT id, competitor_id, CASE WHEN retries < 3 THEN least(priority + 1, 4) ELSE priority END AS priority,
  CASE WHEN retries < 3 THEN retries + 1 ELSE retries END AS retries,
  CASE WHEN retries < 3 THEN 'pending' ELSE 'failed' END AS outcome
FROM (SELECT o_orderkey AS id, o_custkey AS competitor_id, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) - 1 AS priority,
  CAST(floor(o_totalprice / 100000) AS INTEGER) AS retries FROM orders WHERE o_orderstatus = 'P')""")
def _(spark, sf):
    failures = ev.raw(spark, sf, "orders").filter("o_orderstatus = 'P'").selectExpr(
        "o_orderkey AS id", "o_custkey AS competitor_id",
        "CAST(substring(o_orderpriority, 1, 1) AS INT) - 1 AS priority",
        "CAST(floor(o_totalprice / 100000) AS INT) AS retries")
    return fr.requeue_failures(failures)


@query("frontier_stats", """
SELECT o_custkey AS scan_id, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice < 100000) AS pending,
  count(*) FILTER (o_orderstatus = 'O') AS in_progress, count(*) FILTER (o_orderstatus = 'F') AS completed,
  count(*) FILTER (o_orderstatus = 'P' AND o_totalprice >= 100000) AS failed, count(*) AS total_seen
FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    frontier = ev.raw(spark, sf, "orders").selectExpr(
        "o_custkey AS scan_id",
        "CASE o_orderstatus WHEN 'O' THEN 'in_progress' WHEN 'F' THEN 'completed' "
        "ELSE CASE WHEN o_totalprice < 100000 THEN 'pending' ELSE 'failed' END END AS state")
    return fr.frontier_stats(frontier)


# --- robots and sitemaps, one file per host or page of the page table ------------------------

_ROBOTS_BODY = ("concat('# rules\\nUser-agent: *\\nDisallow: /en/*5$\\nDisallow: /fr # french\\nAllow: /en/1\\n"
                "Crawl-delay: 2\\n\\nUser-agent: otherbot\\nDisallow: /\\nSitemap: https://', host, '/map.xml\\n', "
                "if(length(host) % 2 = 0, 'User-agent: *\\nDisallow: /de\\n', ''))")


def robots_docs(spark, sf):
    """Two captures of each host's file; only the newer one counts."""
    hosts = ev.pages(spark, sf).select(urls.host(F.col("url")).alias("host")).distinct()
    return hosts.selectExpr("host", f"{_ROBOTS_BODY} AS body", "2 AS fetched").unionByName(
        hosts.selectExpr("host", "'User-agent: *\\nDisallow: /\\n' AS body", "1 AS fetched"))


_HOSTS_SQL = f"hosts AS (SELECT DISTINCT {sql_host('url')} AS host FROM pages)"


@query("read_robots", f"""
WITH {_HOSTS_SQL} SELECT host, 2 AS pos, 'disallow' AS kind, '/en/*5$' AS pattern FROM hosts
UNION ALL SELECT host, 3, 'disallow', '/fr' FROM hosts UNION ALL SELECT host, 4, 'allow', '/en/1' FROM hosts
UNION ALL SELECT host, 5, 'crawl-delay', '2' FROM hosts
UNION ALL SELECT host, 9, 'sitemap', 'https://' || host || '/map.xml' FROM hosts
UNION ALL SELECT host, 11, 'disallow', '/de' FROM hosts WHERE length(host) % 2 = 0""")
def _(spark, sf):
    return site_files.read_robots(robots_docs(spark, sf), fetched="fetched")


@query("robots_allowed", f"""
WITH p AS (SELECT page_id, url, {sql_host('url')} AS host, {sql_path('url')} AS path FROM pages)
SELECT page_id, url, host, starts_with(path, '/en/1')
  OR NOT (regexp_matches(path, '^/en/.*5$') OR starts_with(path, '/fr')
    OR (length(host) % 2 = 0 AND starts_with(path, '/de'))) AS allowed FROM p""")
def _(spark, sf):
    rules = site_files.read_robots(robots_docs(spark, sf), fetched="fetched")
    return fr.robots_allowed(ev.pages(spark, sf).select("page_id", "url"), rules)


@query("robots_allowed_many_rules", """
WITH rules AS (
  SELECT 'shop' || c_custkey % 3 AS host, 'disallow' AS kind, '/p/' || c_custkey || '/' AS pattern FROM customer WHERE c_custkey % 4 < 3
  UNION ALL SELECT 'shop' || c_custkey % 3, 'allow', '/p/' || c_custkey || '/x' FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'shop' || c_custkey % 3, 'wild', '/' || c_custkey FROM customer WHERE c_custkey % 50 = 7),
targets AS (
  SELECT p_partkey, 'shop' || p_size % 4 AS host, CASE p_partkey % 3 WHEN 0 THEN '/p/' || p_partkey || '/x' || p_size
    WHEN 1 THEN '/p/' || p_partkey || '/y' ELSE '/q/' || p_size || '/' || p_partkey END AS path FROM part)
SELECT p_partkey, 'http://' || t.host || path AS url, t.host,
  EXISTS (SELECT 1 FROM rules r WHERE r.host = t.host AND kind = 'allow' AND starts_with(path, pattern))
  OR NOT EXISTS (SELECT 1 FROM rules r WHERE r.host = t.host
    AND (kind = 'disallow' AND starts_with(path, pattern) OR kind = 'wild' AND starts_with(path, '/q/') AND ends_with(path, pattern))) AS allowed
FROM targets t""")
def _(spark, sf):
    rules = ev.raw(spark, sf, "customer").selectExpr(
        "concat('shop', c_custkey % 3) AS host",
        "stack(3, 'disallow', if(c_custkey % 4 < 3, concat('/p/', c_custkey, '/'), null), "
        "'allow', if(c_custkey % 2 = 0, concat('/p/', c_custkey, '/x'), null), "
        "'disallow', if(c_custkey % 50 = 7, concat('/q/*/', c_custkey, '$'), null)) AS (kind, pattern)").filter("pattern IS NOT NULL")
    targets = ev.raw(spark, sf, "part").selectExpr("p_partkey", """concat('http://shop', p_size % 4, CASE p_partkey % 3
        WHEN 0 THEN concat('/p/', p_partkey, '/x', p_size) WHEN 1 THEN concat('/p/', p_partkey, '/y')
        ELSE concat('/q/', p_size, '/', p_partkey) END) AS url""")
    return fr.robots_allowed(targets, rules)


@query("merge_sitemap_sources", f"""
WITH p AS (SELECT DISTINCT lower({_sql_part('url', 1)}) AS scheme, {sql_host('url')} AS host FROM pages)
SELECT host, 'https://' || host || '/map.xml' AS sitemap_url FROM p
UNION SELECT host, scheme || '://' || host || '/sitemap.xml' FROM p WHERE ends_with(host, '.com')""")
def _(spark, sf):
    rules = site_files.read_robots(robots_docs(spark, sf), fetched="fetched")
    files = ev.pages(spark, sf).select(urls.host(F.col("url")).alias("host"), urls.scheme(F.col("url")).alias("scheme")).selectExpr(
        "host", "scheme", "explode(array('/sitemap.xml', '/sitemap1.xml', '/other.xml')) AS path",
        "CASE WHEN host LIKE '%.com' THEN 200 ELSE 404 END AS status").withColumn(
        "content_type", F.when(F.col("path") == "/sitemap1.xml", "image/png").otherwise("application/xml"))
    return fr.merge_sitemap_sources(rules, files)


_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"


@query("read_sitemaps", f"""
WITH p AS (SELECT page_id, lower({_sql_part('url', 1)}) || '://' || {sql_host('url')} AS root, {_HREFS} AS hrefs FROM pages)
SELECT 'index:' || page_id AS root, root || h AS url, '2024-01-0' || CAST(least(i, 9) AS VARCHAR) AS lastmod,
  CASE WHEN i = 1 THEN 0.9 WHEN i = 2 THEN 0.5 ELSE 0.3 END::DOUBLE AS priority, NULL::VARCHAR AS changefreq
FROM (SELECT page_id, root, unnest(hrefs) AS h, generate_subscripts(hrefs, 1) AS i FROM p)""")
def _(spark, sf):
    # One index file per page naming one child file that lists the page's links.
    base = ev.pages(spark, sf).select(
        "page_id", F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host(F.col("url"))).alias("root"),
        F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)).alias("hrefs"))
    entry = F.transform("hrefs", lambda h, i: F.concat(
        F.lit("<url><loc>"), F.col("root"), h, F.lit("</loc><lastmod>2024-01-0"),
        F.least(i + 1, F.lit(9)).cast("string"), F.lit("</lastmod><priority>"),
        F.when(i == 0, "0.9").when(i == 1, "high").otherwise("0.3"), F.lit("</priority></url>")))
    xmlns = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    children = base.select(
        F.concat(F.lit("child:"), "page_id").alias("url"),
        F.concat(F.lit(xmlns), F.array_join(entry, ""), F.lit("</urlset>")).alias("body"))
    indexes = base.select(
        F.concat(F.lit("index:"), "page_id").alias("url"),
        F.concat(F.lit("<sitemapindex><sitemap><loc>child:"), "page_id",
                 F.lit("</loc></sitemap></sitemapindex>")).alias("body"))
    return site_files.read_sitemaps(children.unionByName(indexes))


@query("read_sitemaps_nested", """
WITH RECURSIVE p AS (SELECT page_id, page_id // 5 AS section, page_id // 50 AS top FROM pages),
links AS (
  SELECT 'section:' || section AS doc, 'leaf:' || page_id AS child FROM p
  UNION SELECT 'section:' || section, 'top:' || top FROM p
  UNION SELECT 'top:' || top, 'section:' || section FROM p
  UNION SELECT 'top:' || top, 'top:' || xor(top, 1) FROM p
  UNION SELECT 'root:' || top, 'top:' || top FROM p WHERE top % 4 = 0),
files AS (SELECT doc FROM links UNION SELECT 'leaf:' || page_id FROM p),
reach AS (SELECT doc AS root, doc FROM files UNION SELECT r.root, l.child FROM reach r JOIN links l ON l.doc = r.doc),
firsts AS (SELECT doc FROM files WHERE doc NOT IN (SELECT child FROM links WHERE child <> doc)),
unread AS (SELECT doc FROM files WHERE doc NOT IN (SELECT r.doc FROM reach r JOIN firsts f ON r.root = f.doc)),
parents AS (SELECT l.child AS doc, min(l.doc) AS up FROM links l JOIN unread u ON u.doc = l.child JOIN unread v ON v.doc = l.doc
  WHERE l.doc <> l.child GROUP BY l.child),
walk AS (SELECT doc AS origin, up AS doc FROM parents UNION SELECT w.origin, p.up FROM walk w JOIN parents p ON p.doc = w.doc),
rings AS (SELECT DISTINCT min(doc) AS doc FROM walk WHERE origin IN (SELECT origin FROM walk WHERE doc = origin) GROUP BY origin)
SELECT root, 'https://x/' || page_id || '/' || k AS url, '2024-02-0' || k AS lastmod,
  0.5::DOUBLE AS priority, 'daily' AS changefreq
FROM (SELECT r.root, CAST(split_part(r.doc, ':', 2) AS BIGINT) AS page_id FROM reach r
  WHERE r.root IN (SELECT doc FROM firsts UNION SELECT doc FROM rings) AND r.doc LIKE 'leaf:%'), (VALUES (1), (2)) v(k)""")
def _(spark, sf):
    # Leaf files under sections under tops; sections name their top again, tops go round in pairs,
    # and only every fourth top is named by a file that no other names.
    ids = ev.pages(spark, sf).selectExpr("page_id", "page_id div 5 AS section", "page_id div 50 AS top")
    named = ids.selectExpr(
        "stack(5, concat('section:', section), concat('leaf:', page_id), concat('section:', section), concat('top:', top), "
        "concat('top:', top), concat('section:', section), concat('top:', top), concat('top:', top ^ 1), "
        "if(top % 4 = 0, concat('root:', top), null), concat('top:', top)) AS (url, child)").filter("url IS NOT NULL")
    indexes = named.groupBy("url").agg(F.array_join(F.sort_array(F.collect_set("child")), "</loc></sitemap><sitemap><loc>").alias(
        "names")).selectExpr("url", "concat('<sitemapindex><sitemap><loc>', names, '</loc></sitemap></sitemapindex>') AS body")
    entry = "concat('<url><loc>https://x/', page_id, '/', k, '</loc><lastmod>2024-02-0', k, '</lastmod><changefreq>daily</changefreq></url>')"
    leaves = ids.selectExpr("concat('leaf:', page_id) AS url",
                            f"concat('<urlset>', array_join(transform(array(1, 2), k -> {entry}), ''), '</urlset>') AS body")
    return site_files.read_sitemaps(leaves.unionByName(indexes))


# --- text ------------------------------------------------------------------------------------

WS = ev.SQL_WS


def _docs(spark, sf):
    return ev.heavy(spark, sf, "documents")


def sql_normal(text: str) -> str:
    flat = f"regexp_replace(lower({text}), '[{WS}]+', ' ', 'g')"
    return ev.sql_strip(rf"regexp_replace({flat}, '[^\p{{L}}\p{{N}}_{WS}]', '', 'g')")


_NORMAL_SQL = f"normal AS (SELECT doc_id, {sql_normal('text')} AS norm FROM documents)"
_NORMAL_WORDS_SQL = _NORMAL_SQL + f", worded AS (SELECT doc_id, norm, {ev.sql_words('norm')} AS w FROM normal)"


def sql_ngrams(tokens: str, n: int) -> str:
    parts = " || ' ' || ".join(f"{tokens}[i + {k}]" if k else f"{tokens}[i]" for k in range(n))
    return (f"CASE WHEN len({tokens}) >= {n} THEN list_transform(range(1, len({tokens}) - {n - 2}), lambda i: {parts}) "
            "ELSE [] END")


def sql_top(source: str, key: str, tokens: str, n: int) -> str:
    """(key, token, n, rank) rows, most frequent first, ties in first-seen order."""
    return (f"SELECT {key}, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY {key} "
            f"ORDER BY n DESC, pos) AS rank FROM ({ev.sql_token_counts(source, key, tokens)})) WHERE rank <= {n}")


def _exploded_top(df, key: str, counted):
    return unnest(df, [key], counted, "entry", "pos").select(
        key, F.col("entry.token").alias("token"), (-F.col("entry.neg_n")).cast("bigint").alias("n"),
        (F.col("pos") + 1).cast("bigint").alias("rank"))


@query("content_hash", f"SELECT doc_id, {ev.sql_content_hash('text')} AS content_hash FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query("normalize_text", f"WITH {_NORMAL_SQL} SELECT doc_id, norm AS normalized FROM normal")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.normalize_text(F.col("text")).alias("normalized"))


@query("word_count", f"SELECT doc_id, CAST(len({ev.sql_words('text')}) AS INTEGER) AS word_count FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.word_count(F.col("text")).alias("word_count"))


@query("reading_time", f"SELECT doc_id, CAST(ceil(len({ev.sql_words('text')}) / 200.0) AS INTEGER) AS reading_time "
                       "FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.reading_time(tx.word_count(F.col("text"))).alias("reading_time"))


@query("readability", f"SELECT doc_id, {ev.sql_readability('text')} AS readability FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.readability(F.col("text")).alias("readability"))


_STOPPED = (f"list_filter({ev.sql_ascii_words('text')}, lambda w: NOT list_contains("
            f"{ev.sql_list(tx.KEYWORD_STOP_WORDS)}, w))")


@query("top_keywords", "WITH t AS (SELECT doc_id, " + _STOPPED + " AS tokens FROM documents) "
       + sql_top("t", "doc_id", "tokens", 10))
def _(spark, sf):
    counted = tx.top(tx.without(tx.ascii_words(F.col("text")), tx.KEYWORD_STOP_WORDS), 10)
    return _exploded_top(_docs(spark, sf), "doc_id", counted)


@query("raw_keyword_counts", rf"""
WITH t AS (SELECT doc_id, list_filter(list_transform({ev.sql_words('lower(text)')},
  lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}_]', '', 'g')), lambda w: length(w) > 3) AS tokens FROM documents)
""" + sql_top("t", "doc_id", "tokens", 20))
def _(spark, sf):
    return _exploded_top(_docs(spark, sf), "doc_id", tx.raw_keyword_counts(F.col("text")))


@query("top_phrases", f"WITH {_NORMAL_WORDS_SQL}, t AS (SELECT doc_id, {sql_ngrams('w', 3)} AS tokens FROM worded) "
       + "SELECT doc_id, token AS phrase, rank FROM (" + sql_top("t", "doc_id", "tokens", 10) + ")"
       + " UNION ALL SELECT doc_id, unnest(w), generate_subscripts(w, 1) FROM worded WHERE len(w) < 3")
def _(spark, sf):
    phrases = tx.top_phrases(tx.normalize_text(F.col("text")))
    return unnest(_docs(spark, sf), ["doc_id"], phrases, "phrase", "pos").select(
        "doc_id", "phrase", (F.col("pos") + 1).cast("bigint").alias("rank"))


@query("keyword_phrases", "WITH t AS (SELECT doc_id, " + _STOPPED + " AS w FROM documents), "
       f"g AS (SELECT doc_id, {sql_ngrams('w', 2)} AS tokens FROM t) " + sql_top("g", "doc_id", "tokens", 5))
def _(spark, sf):
    tokens = tx.without(tx.ascii_words(F.col("text")), tx.KEYWORD_STOP_WORDS)
    return _exploded_top(_docs(spark, sf), "doc_id", tx.top(ngrams(tokens, 2), 5))


@query("content_category", f"""
SELECT doc_id, url, {ev.sql_category('url', 'title')} AS category FROM (SELECT doc_id, text AS title,
  'https://' || source || '.example.com/' || CASE lang WHEN 'en' THEN 'blog/' WHEN 'fr' THEN 'Pricing/'
  WHEN 'de' THEN 'x/y/' ELSE '' END || doc_id AS url FROM documents)""")
def _(spark, sf):
    located = _docs(spark, sf).selectExpr(
        "doc_id", "text AS title",
        "concat('https://', source, '.example.com/', CASE lang WHEN 'en' THEN 'blog/' WHEN 'fr' THEN 'Pricing/' "
        "WHEN 'de' THEN 'x/y/' ELSE '' END, doc_id) AS url")
    return located.select("doc_id", "url", tx.content_category(F.col("url"), F.col("title")).alias("category"))


def _sql_half(prefix: str, col: str) -> str:
    votes = " + ".join(
        f"CASE WHEN coalesce(sum(CASE WHEN {col} & {1 << i} <> 0 THEN 1 ELSE -1 END), 0) >= 0 "
        f"THEN {1 << i}::BIGINT ELSE 0::BIGINT END" for i in range(32))
    return f"({votes}) AS {prefix}"


_SIMHASH_SQL = _NORMAL_WORDS_SQL + f""",
tokens AS (SELECT doc_id, md5(unnest(w)) AS m FROM worded),
halves AS (SELECT doc_id, CAST('0x' || substring(m, 17, 8) AS BIGINT) AS a,
  CAST('0x' || substring(m, 25, 8) AS BIGINT) AS b FROM tokens),
hashed AS (SELECT doc_id, {_sql_half('hi', 'a')}, {_sql_half('lo', 'b')} FROM halves GROUP BY doc_id),
simhashes AS (SELECT worded.doc_id, sha256(norm) AS full_hash, coalesce(hi, 4294967295) AS hi,
  coalesce(lo, 4294967295) AS lo, len(w) AS n_words, length(norm) AS n_chars
  FROM worded LEFT JOIN hashed ON hashed.doc_id = worded.doc_id)"""
_SIMHASH_HEX = "lpad(lower(to_hex(hi)), 8, '0') || lpad(lower(to_hex(lo)), 8, '0')"


def _fingerprints(spark, sf):
    return fp.fingerprint(_docs(spark, sf), "doc_id", "text")


def _simhashes(spark, sf):
    return fp.simhash64(_docs(spark, sf), "doc_id", "text")


_PHRASE_HASH_SQL = f""",
grams AS (SELECT doc_id, {sql_ngrams('w', 3)} AS tokens FROM worded),
best AS ({sql_top('grams', 'doc_id', 'tokens', 10)}),
phrases AS (SELECT doc_id, string_agg(token, ' ' ORDER BY rank) AS p FROM best GROUP BY doc_id)"""


@query("fingerprint", f"""
WITH {_SIMHASH_SQL}{_PHRASE_HASH_SQL}
SELECT s.doc_id, full_hash, {_SIMHASH_HEX} AS simhash,
  md5(coalesce(p, array_to_string(w, ' '))) AS phrase_hash,
  CAST(n_words AS INTEGER) AS word_count, CAST(n_chars AS INTEGER) AS char_count
FROM simhashes s JOIN worded ON worded.doc_id = s.doc_id LEFT JOIN phrases ON phrases.doc_id = s.doc_id""")
def _(spark, sf):
    return _fingerprints(spark, sf).select("doc_id", "full_hash", "simhash", "phrase_hash", "word_count",
                                           "char_count")


@query("simhash64", f"WITH {_SIMHASH_SQL} SELECT doc_id, {_SIMHASH_HEX} AS simhash FROM simhashes")
def _(spark, sf):
    return _simhashes(spark, sf).select("doc_id", "simhash")


@query("fingerprint_similarity", f"""
WITH {_SIMHASH_SQL}, later AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' Neu im Angebot.' ELSE text END
  AS text FROM documents),
""" + _SIMHASH_SQL.replace("normal AS", "normal2 AS").replace("FROM normal)", "FROM normal2)")
       .replace("FROM documents", "FROM later").replace("worded", "worded2").replace("tokens", "tokens2")
       .replace("halves", "halves2").replace("hashed", "hashed2").replace("simhashes", "simhashes2") + """
SELECT a.doc_id, CASE WHEN a.full_hash = b.full_hash THEN 1.0::DOUBLE
  ELSE 1.0::DOUBLE - (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::DOUBLE / 64 END AS similarity
FROM simhashes a JOIN simhashes2 b ON b.doc_id = a.doc_id""")
def _(spark, sf):
    later = _docs(spark, sf).withColumn(
        "text", F.when(F.col("lang") == "de", F.concat(F.col("text"), F.lit(" Neu im Angebot."))).otherwise(F.col("text")))
    return fp.fingerprint_similarity(_fingerprints(spark, sf), fp.fingerprint(later, "doc_id", "text"), "doc_id")


@query("copy_groups", f"""
WITH {_NORMAL_SQL}, h AS (SELECT doc_id, sha256(norm) AS full_hash FROM normal)
SELECT h.doc_id, h.full_hash, first_key, copies FROM h JOIN (
  SELECT full_hash, min(doc_id) AS first_key, count(*) AS copies FROM h GROUP BY full_hash) g
ON g.full_hash = h.full_hash""")
def _(spark, sf):
    hashed = _docs(spark, sf).select("doc_id", F.sha2(tx.normalize_text(F.col("text")), 256).alias("full_hash"))
    return fp.copy_groups(hashed, "doc_id")


_NEAR_SQL = f"""
WITH {_SIMHASH_SQL},
v AS (SELECT hi, lo, min(doc_id) AS first_key, count(*) AS texts FROM simhashes GROUP BY hi, lo),
d AS (SELECT a.first_key AS ka, b.first_key AS kb, a.texts AS ta, b.texts AS tb,
    bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS distance FROM v a JOIN v b ON a.first_key < b.first_key)
SELECT ka AS first_key, kb AS other_key, ta AS first_texts, tb AS other_texts, CAST(distance AS INTEGER) AS distance
FROM d WHERE distance <= 3"""


def _by_first_key(pairs):
    ahead = F.col("first_key_a") < F.col("first_key_b")

    def pick(name: str, first: bool):
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        return F.when(ahead, a if first else b).otherwise(b if first else a)

    return pairs.select(
        pick("first_key", True).alias("first_key"), pick("first_key", False).alias("other_key"),
        pick("texts", True).alias("first_texts"), pick("texts", False).alias("other_texts"), "distance")


@query("near_duplicates", _NEAR_SQL)
def _(spark, sf):
    return _by_first_key(fp.near_duplicates(_simhashes(spark, sf), "doc_id"))


@query("near_duplicates_incremental", _NEAR_SQL)
def _(spark, sf):
    # The documents in three batches; a batch hashes its own texts only.
    index = fp.SimhashIndex(spark, scratch_dir(spark, "simhash-index"), buckets=8)
    for batch in range(3):
        part = _docs(spark, sf).filter(F.pmod(F.hash("doc_id"), F.lit(3)) == batch)
        index.add(fp.simhash64(part, "doc_id", "text"), "doc_id", batch)
    return _by_first_key(index.pairs())


@query("near_duplicate_groups", f"""
WITH RECURSIVE {_SIMHASH_SQL},
v AS (SELECT hi, lo, min(doc_id) AS first_key, count(*) AS texts FROM simhashes GROUP BY hi, lo),
e AS (SELECT a.first_key AS a, b.first_key AS b FROM v a JOIN v b
  ON bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
g AS (SELECT a AS first_key, min(b) AS group_key FROM reach GROUP BY a)
SELECT s.doc_id, group_key, CAST(sum(count(*)) OVER (PARTITION BY group_key) AS BIGINT) AS group_texts
FROM simhashes s JOIN v ON v.hi = s.hi AND v.lo = s.lo JOIN g USING (first_key) GROUP BY s.doc_id, group_key""")
def _(spark, sf):
    return fp.near_duplicate_groups(_simhashes(spark, sf), "doc_id").select("doc_id", "group_key", "group_texts")

"""Crawl frontier, robots rules and registrable domains as table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import urls
from marketlens.plans.skew import with_position


def registrable_domain(df: DataFrame, host_col: str, suffixes: DataFrame, out: str = "domain") -> DataFrame:
    """Last label before the longest known suffix, plus that suffix.

    ``suffixes`` has one column ``suffix``. Work is done once per distinct host;
    a host with many rows only meets one row in the final join. A host without a
    known suffix falls back to its last two labels.
    """
    hosts = df.select(F.col(host_col).alias("_host")).where("_host <> ''").distinct()
    labels = F.split(F.regexp_replace("_host", r":\d+$", ""), r"\.")
    tails = hosts.withColumn("_labels", labels).select("_host", "_labels", F.explode(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_labels") - 1))).alias("_start"))
    named = tails.select("_host", "_start", F.array_join(F.expr("slice(_labels, _start + 1, size(_labels))"), ".")
                         .alias("suffix"), "_labels")
    longest = (
        named.join(suffixes.select("suffix", F.lit(True).alias("_hit")), "suffix", "left")
        .groupBy("_host").agg(
            F.min(F.when(F.col("_hit"), F.col("_start"))).alias("_start"), F.first("_labels").alias("_labels"))
    )
    start = F.coalesce("_start", F.greatest(F.lit(1), F.size("_labels") - 1))
    known = longest.select("_host", start.alias("_start"), "_labels").select(
        F.col("_host").alias(host_col),
        F.array_join(F.expr("slice(_labels, _start, size(_labels))"), ".").alias(out))
    return df.join(known, host_col, "left")


def registrable_by_rules(df: DataFrame, host_col: str, rules: DataFrame, private: bool = False,
                         out: str = "domain") -> DataFrame:
    """Registrable domain of each host by suffix rules, wildcard and exception rules included.

    ``rules`` has a column ``rule`` and may have a boolean ``private``; private rules
    count only on request. A rule is a suffix such as ``co.uk``; ``*.ck`` makes every
    label before ``ck`` part of a suffix, ``!www.ck`` takes one out again. The rule of
    most labels holds, an exception before all; without a rule the last label is the
    suffix. The domain is the suffix and one label more, null for a host that is a
    suffix itself, an address or empty. Ports, a closing dot and the case of the host
    do not matter. Rules are looked up once per distinct host by equality of reversed
    names: each host meets as many names as it has labels.
    """
    listed = rules if private or "private" not in rules.columns else rules.filter(~F.coalesce("private", F.lit(False)))
    text = F.lower(F.trim("rule"))
    known = listed.filter("rule IS NOT NULL").select(
        F.regexp_replace(text, r"^(!|\*\.)", "").alias("_name"), F.startswith(text, F.lit("!")).alias("_not"),
        F.startswith(text, F.lit("*.")).alias("_any")).groupBy("_name").agg(
        F.bool_or("_not").alias("_not"), F.bool_or("_any").alias("_any"), F.bool_or(~F.col("_not") & ~F.col("_any")).alias("_plain"))
    hosts = df.select(F.col(host_col).alias("_host")).where("_host <> ''").distinct()
    bare = F.regexp_replace(F.regexp_replace(F.lower("_host"), r":\d*$", ""), r"\.$", "")
    # Labels from the end: the name of n labels is made of the first n.
    labels = hosts.select("_host", F.reverse(F.split(bare, r"\.")).alias("_labels")).filter(
        ~F.rlike(bare, F.lit(r"^\[|^[0-9.]+$")) & ~F.exists("_labels", lambda x: x == ""))
    names = labels.select("_host", "_labels", F.explode(F.sequence(F.lit(1), F.size("_labels"))).alias("_n")).withColumn(
        "_name", F.array_join(F.reverse(F.slice("_labels", 1, F.col("_n"))), "."))
    n = F.col("_n")
    ruled = names.join(known, "_name", "left").groupBy("_host").agg(
        F.first("_labels").alias("_labels"),
        F.max(F.when(F.col("_not"), n - 1)).alias("_except"),
        F.max(F.greatest(F.when(F.col("_plain"), n), F.when(F.col("_any") & (n < F.size("_labels")), n + 1))).alias("_rule"))
    suffix = F.coalesce("_except", "_rule", F.lit(1))
    found = ruled.filter(F.size("_labels") > suffix).select(
        F.col("_host").alias(host_col), F.array_join(F.reverse(F.slice("_labels", 1, suffix + 1)), ".").alias(out))
    return df.join(found, host_col, "left")


def plan_frontier(links: DataFrame, seen: DataFrame, max_depth: int | None = None, max_urls: int | None = None,
                  batch: int | None = None) -> DataFrame:
    """Urls to fetch next per scan, in crawl order.

    ``links``: scan_id, url, depth, priority, added. ``seen``: scan_id, url, one
    row each. With ``max_depth`` deeper links are left out; with ``max_urls`` a scan
    never holds more urls, seen ones included, and earlier additions win. Order is
    priority, then time of addition; positions are numbered by ranges, so a scan may
    have any number of urls.
    """
    shallow = links if max_depth is None else links.filter(F.col("depth") <= max_depth)
    fresh = shallow.groupBy("scan_id", "url").agg(
        F.min(F.struct("added", "priority", "depth")).alias("_first")).select("scan_id", "url", "_first.*")
    admitted = fresh.join(seen.select("scan_id", "url"), ["scan_id", "url"], "left_anti")
    if max_urls is not None:
        used = seen.groupBy("scan_id").agg(F.count(F.lit(1)).alias("_used"))
        admitted = with_position(admitted, [F.col("added"), F.col("url")], "_order", ["scan_id"]).join(
            used, "scan_id", "left").filter(
            F.col("_order") <= max_urls - F.coalesce("_used", F.lit(0))).drop("_order", "_used")
    planned = with_position(admitted, [F.col(c) for c in ("priority", "added", "url")], "position", ["scan_id"])
    return planned if batch is None else planned.filter(F.col("position") <= batch)


def requeue_failures(failures: DataFrame, max_retries: int = 3) -> DataFrame:
    """Failed fetches: retried one priority lower, or given up (``outcome`` failed)."""
    again = F.col("retries") < max_retries
    return failures.select(
        *[c for c in failures.columns if c not in ("priority", "retries")],
        F.when(again, F.least(F.col("priority") + 1, F.lit(urls.DEFERRED))).otherwise(F.col("priority"))
        .alias("priority"),
        F.when(again, F.col("retries") + 1).otherwise(F.col("retries")).alias("retries"),
        F.when(again, "pending").otherwise("failed").alias("outcome"),
    )


def frontier_stats(frontier: DataFrame) -> DataFrame:
    """Urls per state and scan."""
    state = F.col("state")
    return frontier.groupBy("scan_id").agg(
        *[F.count_if(state == s).alias(s) for s in ("pending", "in_progress", "completed", "failed")],
        F.count(F.lit(1)).alias("total_seen"))


#: Rules of a host from which they are joined to paths by their literal text; BLOCK_URLS no longer says anything.
MANY_RULES, BLOCK_URLS = 256, 4096


def _wanted_rules(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("kind").isin("allow", "disallow")).select("host", "kind", "pattern").distinct()


def _wildcards() -> tuple[Column, Column, Column]:
    """Whether ``pattern`` holds a wildcard, its regular expression, and the literal text before the first wildcard."""
    wild = F.col("pattern").contains("*") | F.endswith("pattern", F.lit("$"))
    escaped = F.regexp_replace("pattern", r"([.\[\]{}()+?^|\\$])", r"\\$1")
    regex = F.concat(F.lit("(?s)^"), F.regexp_replace(F.replace(escaped, F.lit("*"), F.lit(".*")), r"\\\$$", r"\$"))
    return wild, regex, F.regexp_replace(F.substring_index("pattern", "*", 1), r"\$$", "")


def robots_index(rules: DataFrame) -> DataFrame:
    """One row per host: for allow and disallow a sorted array of prefixes and an array of wildcard rules.

    Of prefixes that begin with another only the shorter stays, so the greatest one
    not above a path is the only one it can begin with. Wildcard rules are regular
    expressions with the literal text before their first wildcard. ``n_rules`` counts both.
    """
    wanted = _wanted_rules(rules)
    wild, regex, literal = _wildcards()
    # All strings that begin with p stand from p to below p with the last code point behind it.
    before = Window.partitionBy("host", "kind").orderBy("pattern").rowsBetween(Window.unboundedPreceding, -1)
    plain = wanted.filter(~wild).withColumn("_open", F.max(F.concat("pattern", F.lit("\U0010ffff"))).over(before)).filter(
        F.col("_open").isNull() | (F.col("_open") <= F.col("pattern")))
    both = plain.select("host", "kind", "pattern", F.lit(None).cast("struct<literal:string,regex:string>").alias("wild")).unionByName(
        wanted.filter(wild).select("host", "kind", F.lit(None).cast("string").alias("pattern"),
                                   F.struct(literal.alias("literal"), regex.alias("regex")).alias("wild")))
    columns = []
    for kind in ("allow", "disallow"):
        own = F.col("kind") == kind
        columns += [F.array_sort(F.collect_list(F.when(own, F.col("pattern")))).alias(f"_{kind}"),
                    F.array_sort(F.collect_list(F.when(own, F.col("wild")))).alias(f"_{kind}_wild")]
    return both.groupBy("host").agg(*columns, F.count(F.lit(1)).alias("n_rules"))


def _begins_with_one(path: Column, prefixes: Column) -> Column:
    """Whether a path begins with one of sorted prefixes of which none begins with another, by halving steps."""
    def half(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(prefixes, middle) <= path
        return F.when(s["low"] >= s["high"], s).when(
            below, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), middle.alias("high")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(prefixes) + F.lit(1))).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(prefixes).alias("high")), half, lambda s: s["low"])
    return F.coalesce(F.startswith(path, F.get(prefixes, found - 1)), F.lit(False))


def _allowed(path: Column) -> Column:
    def hit(kind: str) -> Column:
        wild = F.exists(F.col(f"_{kind}_wild"), lambda w: F.startswith(path, w["literal"]) & F.rlike(path, w["regex"]))
        return F.coalesce(_begins_with_one(path, F.col(f"_{kind}")) | wild, F.lit(False))

    return hit("allow") | ~hit("disallow")


def _rule_keys(rules: DataFrame) -> DataFrame:
    """Rules as keys to look up: host, kind, the literal text they begin with, the longest one after a wildcard, and a regular expression.

    ``place`` says where the second text must stand: at the ``end`` of a path,
    ``inside`` it behind the first, or nowhere (``none``: it is empty).
    """
    wild, regex, literal = _wildcards()
    closed = F.endswith("pattern", F.lit("$"))
    body = F.when(closed, F.expr("left(pattern, length(pattern) - 1)")).otherwise(F.col("pattern"))
    pieces = F.split(body, r"\*")
    later = F.slice(F.transform(pieces, lambda p, i: F.struct(
        F.length(p).alias("size"), (closed & (i == F.size(pieces) - 1)).alias("last"), p.alias("text"))), F.lit(2), F.size(pieces))
    longest = F.array_max(later)
    text = F.when(wild, F.coalesce(longest["text"], F.lit(""))).otherwise(F.lit(""))
    place = F.when(text == "", "none").when(longest["last"], "end").otherwise("inside")
    return rules.select(
        "host", "kind", F.when(wild, literal).otherwise(F.col("pattern")).alias("start"), text.alias("text"),
        place.alias("place"), F.when(wild, regex).alias("regex"))


def _allowed_by_keys(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """host, _path, allowed for distinct paths of hosts with many rules.

    A path is asked for by the beginnings and pieces it could share with a rule, one for
    each combination of lengths that its host's rules have; equal ones are joined and only
    those rules tried. So neither all rules of a host nor all its urls meet in one row.
    """
    keys = _rule_keys(rules)
    shapes = keys.select("host", "place", F.length("start").alias("a"), F.length("text").alias("b")).distinct().groupBy("host").agg(
        F.collect_list(F.struct("place", "a", "b")).alias("_shapes"))
    path = F.col("_path")
    # A closing $ also stands before a line end that ends the path.
    bare = F.regexp_replace(path, r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])\z", "")

    def asked(s: Column) -> Column:
        def found(text: Column) -> Column:
            return F.struct(F.substring(path, F.lit(1), s["a"]).alias("start"), text.alias("text"), s["place"].alias("place"))

        def ends(p: Column) -> Column:
            return F.substring(p, F.length(p) - s["b"] + 1, s["b"])

        last = F.length(path) - s["b"] + 1
        pieces = F.array_distinct(F.transform(F.sequence(s["a"] + 1, last), lambda i: found(F.substring(path, i, s["b"]))))
        return F.when(F.length(path) < s["a"] + s["b"], F.array().cast(
            "array<struct<start:string,text:string,place:string>>")).when(
            s["place"] == "none", F.array(found(F.lit("")))).when(
            s["place"] == "end", F.array_distinct(F.array(found(ends(path)), found(ends(bare))))).otherwise(pieces)

    asking = paths.join(shapes, "host").select("host", "_path", F.inline(F.flatten(F.transform("_shapes", asked))))
    tried = asking.join(keys, ["host", "start", "text", "place"]).filter(
        F.col("regex").isNull() | F.rlike(path, F.col("regex")))
    hit = tried.groupBy("host", "_path").agg(
        F.bool_or(F.col("kind") == "allow").alias("_allow"))
    return hit.select("host", "_path", F.col("_allow").alias("allowed"))


def robots_allowed(targets: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Whether each url may be fetched: any matching allow, else no matching disallow.

    Rules become one row per host, holding the patterns of a single robots file
    (``read_robots`` takes one capture per host). A path is looked up among the plain
    prefixes, nearly all rules, in as many steps as their number has binary digits; a
    wildcard rule is tried only where the path begins with its literal part. A joined
    row holds all rules of its host, so hosts with ``MANY_RULES`` or more are left out of
    that: their paths and rules are joined by the literal text that both must have. The
    result is the same either way.
    """
    columns = [*[c for c in targets.columns if c != "host"], "host"]
    checked = targets.withColumns({"host": urls.host(F.col(url)), "_path": urls.path(F.col(url))}).withColumn(
        "_path", F.when(F.col("_path") == "", "/").otherwise(F.col("_path")))
    wanted = _wanted_rules(rules)
    many = wanted.groupBy("host").agg(F.count(F.lit(1)).alias("n_rules")).filter(
        (F.col("n_rules") >= MANY_RULES) & F.col("host").isNotNull()).select("host")
    if many.isEmpty():
        return checked.join(robots_index(rules), "host", "left").withColumn("allowed", _allowed(F.col("_path"))).select(
            *columns, "allowed")
    few = checked.join(many, "host", "left_anti")
    at_once = few.join(robots_index(rules.join(many, "host", "left_anti")), "host", "left").withColumn(
        "allowed", _allowed(F.col("_path"))).select(*columns, "allowed")
    owned = checked.join(many, "host", "left_semi")
    hits = _allowed_by_keys(owned.select("host", "_path").distinct(), wanted.join(many, "host", "left_semi"))
    tried = owned.join(hits, ["host", "_path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True))).select(*columns, "allowed")
    return at_once.unionByName(tried)


# Places where sites usually keep a sitemap.
SITEMAP_PATHS = [
    "/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemaps.xml", "/sitemap1.xml",
    "/post-sitemap.xml", "/page-sitemap.xml", "/product-sitemap.xml",
]


def merge_sitemap_sources(rules: DataFrame, site_files: DataFrame) -> DataFrame:
    """Sitemaps of each host: named in robots rules, or answered at a usual place."""
    named = rules.filter("kind = 'sitemap'").select("host", F.col("pattern").alias("sitemap_url"))
    answered = site_files.filter(
        F.col("path").isin(SITEMAP_PATHS) & (F.col("status") == 200)
        & (F.col("content_type").contains("xml") | F.col("content_type").contains("text")))
    found = answered.select("host", F.concat("scheme", F.lit("://"), "host", "path").alias("sitemap_url"))
    return named.unionByName(found).distinct()

"""Robots and sitemap files, already fetched, read as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.plans.skew import latest_per_key, top_n_per_key
from marketlens.session import scratch_dir

AGENTS = ("*", "googlebot")


def read_robots(docs: DataFrame, sticky: bool = False, fetched: str | None = None) -> DataFrame:
    """Rule rows (host, pos, kind, pattern) of robots files, one file per host.

    Of several captures of a host the newest by the ``fetched`` column is read, or,
    without such a column, the one whose body is the last in order.

    Kinds are allow, disallow, crawl-delay and sitemap. Rules count when their
    group names ``*`` or ``googlebot``; with ``sticky`` an agent once named stays
    named for the rest of the file.
    """
    docs = latest_per_key(docs, ["host"], fetched or "body", *(["body"] if fetched else []))
    lines = docs.select("host", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    bare = F.trim(F.regexp_replace(F.split_part("line", F.lit("#"), F.lit(1)), r"\r", ""))
    fields = lines.withColumn("line", bare).filter(F.contains("line", F.lit(":"))).select(
        "host", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("kind"),
        F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("pattern"))
    order = Window.partitionBy("host").orderBy("pos")
    is_agent = F.col("kind") == "user-agent"
    ours = (is_agent & F.lower("pattern").isin(*AGENTS)).cast("int")
    if sticky:
        named = fields.withColumn("_ours", F.max(ours).over(order))
    else:
        starts = is_agent & (F.coalesce(F.lag("kind").over(order), F.lit("")) != "user-agent")
        grouped = fields.withColumn("_starts", starts.cast("int")).withColumn(
            "_group", F.sum("_starts").over(order))
        named = grouped.withColumn("_ours", F.max(ours).over(Window.partitionBy("host", "_group").orderBy("pos")))
    rule = (F.col("_ours") == 1) & F.col("kind").isin("allow", "disallow", "crawl-delay")
    return (
        named.filter((rule | (F.col("kind") == "sitemap")) & (F.col("pattern") != ""))
        .filter((F.col("kind") != "crawl-delay") | F.col("pattern").try_cast("double").isNotNull())
        .select("host", "pos", "kind", "pattern")
    )


_SITEMAP = ("url array<struct<loc:string,lastmod:string,priority:string,changefreq:string>>, "
            "sitemap array<struct<loc:string>>")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _reached(links: DataFrame, tops: DataFrame) -> DataFrame:
    """root, doc, path: every file that the tops (doc) lead to over links (doc, pos, child), each once per root.

    One round per level of nesting; a round follows only the files that the one before
    found for the first time and is written before the next, so a ring of files ends
    the walk instead of the job. ``path`` has the places of the links followed, the
    least of the shortest ways; in its order files stand as a reader meets them.
    """
    spark, base = links.sparkSession, scratch_dir(links.sparkSession, "sitemap-levels")
    front = _written(tops.select(
        F.col("doc").alias("root"), "doc", F.array().cast("array<int>").alias("path")), f"{base}/level=0")
    # The folder of all levels so far is the visited set.
    schema, level = front.schema, 0
    while not front.isEmpty():
        level += 1
        visited = spark.read.schema(schema).parquet(*[f"{base}/level={k}" for k in range(level)])
        found = front.join(links, "doc").groupBy("root", F.col("child").alias("doc")).agg(
            F.min(F.concat("path", F.array("pos"))).alias("path"))
        front = _written(found.join(visited.select("root", "doc"), ["root", "doc"], "left_anti"), f"{base}/level={level}")
    return spark.read.schema(schema).parquet(*[f"{base}/level={k}" for k in range(level + 1)])


def _ring_heads(links: DataFrame) -> DataFrame:
    """The least file (doc) of each ring that going from every child to the least file naming it ends in.

    Every child of ``links`` must be a doc of it too. The way behind a file is doubled
    in each round, so as many rounds do as the number of files has binary digits.
    """
    spark = links.sparkSession
    way = _written(links.groupBy(F.col("child").alias("doc")).agg(F.min("doc").alias("at")).withColumn("least", F.col("doc")),
                   scratch_dir(spark, "sitemap-ways"))
    ahead = way.select(F.col("doc").alias("at"), F.col("at").alias("over"), F.col("least").alias("other"))
    for _ in range(way.count().bit_length()):
        way = _written(way.join(ahead, "at").select("doc", F.col("over").alias("at"), F.least("least", "other").alias("least")),
                       scratch_dir(spark, "sitemap-ways"))
        ahead = way.select(F.col("doc").alias("at"), F.col("at").alias("over"), F.col("least").alias("other"))
    return way.join(ahead, "at").select(F.col("other").alias("doc")).distinct()


def _sitemap_tree(files: DataFrame, links: DataFrame) -> DataFrame:
    """root, doc, path over all files: roots are files that no other names, and the heads of rings left over."""
    others = links.filter("child <> doc")
    seen = _reached(links, files.join(others.select(F.col("child").alias("doc")), "doc", "left_anti"))
    left = _written(files.join(seen.select("doc"), "doc", "left_anti"), scratch_dir(files.sparkSession, "sitemaps-left"))
    if left.isEmpty():
        return seen
    # What is left is named only by files that are left too.
    among = others.join(left, "doc").join(left.select(F.col("doc").alias("child")), "child", "left_semi")
    return seen.unionByName(_reached(links, _ring_heads(among)))


def read_sitemaps(docs: DataFrame, max_urls: int | None = None, max_nested: int | None = None,
                  roots: DataFrame | None = None) -> DataFrame:
    """Urls of sitemap files (url, body), index files followed to any depth.

    Returns root, url, lastmod, priority and changefreq: the entries of every file that
    a root leads to, each file once per root however many ways lead to it. ``roots``
    (url) names the files to begin with; by default these are the files that no other
    names. Files that none of them leads to are named in rings: going from each to the
    least file that names it ends in one, whose least file is a root. ``max_nested`` reads
    so many children of an index, ``max_urls`` keeps so many urls per root, in reading
    order; by default all. Files that are not well-formed give no rows. Every file is
    parsed once, to rows that are written before they are joined.
    """
    parsed = docs.select(F.col("url").alias("doc"), F.from_xml(
        "body", _SITEMAP, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("x"))
    # A file naming child sitemaps is an index; its own url entries do not count.
    none = F.lit(None).cast("string")
    children = F.transform("x.sitemap", lambda s: F.struct(
        s["loc"].alias("loc"), none.alias("lastmod"), none.alias("priority"), none.alias("changefreq")))
    is_index = F.size(F.coalesce("x.sitemap", F.array())) > 0
    listed = parsed.filter("doc IS NOT NULL").select("doc", is_index.alias("is_index"), F.posexplode(
        F.when(is_index, children).otherwise(F.col("x.url"))).alias("pos", "u")).select("doc", "is_index", "pos", "u.*")
    lines = _written(listed, scratch_dir(docs.sparkSession, "sitemaps")).filter("loc IS NOT NULL")

    entries = lines.filter("NOT is_index")
    # A file that several captures hold names a child at its first place.
    links = lines.filter("is_index").select("doc", "pos", F.col("loc").alias("child"))
    if max_nested is not None:
        links = links.filter(F.col("pos") < max_nested)
    links = links.groupBy("doc", "child").agg(F.min("pos").alias("pos"))
    if roots is None:
        tree = _sitemap_tree(lines.select("doc").distinct(), links)
    else:
        tree = _reached(links, roots.select(F.col("url").alias("doc")).filter("doc IS NOT NULL").distinct())
    rows = tree.join(entries, "doc").select(
        "root", "path", "pos", F.col("loc").alias("url"), "lastmod",
        F.coalesce(F.col("priority").try_cast("double"), F.lit(0.5)).alias("priority"), "changefreq")
    if max_urls is not None:
        rows = top_n_per_key(rows, ["root"], [F.col("path"), F.col("pos")], max_urls)
    return rows.drop("path", "pos")

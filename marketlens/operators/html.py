"""One pass over HTML: pages to flattened nodes and texts, then to columns.

Only :func:`flatten_pages` runs Python; it turns markup into positions and does
nothing else. What counts as a link, a price or a product card is said in
columns, so it is pruned, pushed and compiled by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import dom
from marketlens.functions import text as tx
from marketlens.functions import urls
from marketlens.functions.arrays import let, unnest
from marketlens.functions.prices import (
    DISCOUNT_PATTERNS, detect_currency, extract_price_values, first_price_text, normalize_price,
    sale_from_original)

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
         "track", "wbr"}
_ZONES = {"head", "title", "script", "style", "nav", "footer", "header", "aside", "form"}
# A start tag closes an open element of these kinds, unless one of the limits lies between.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_BLOCKS = {"p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article",
           "aside", "header", "footer", "nav", "main", "form", "blockquote", "pre", "hr"}
_P_LIMITS = {"div", "td", "th", "li", "section", "article", "main", "body", "button"}

DOM_SCHEMA = (
    "nodes array<struct<id:int,last:int,parent:int,index:int,node_to:int,text_from:int,text_to:int,tag:string,"
    "attrs:map<string,string>,zones:array<string>>>, "
    "texts array<struct<pos:int,text:string,zones:array<string>>>")
_NODES = pa.list_(pa.struct([
    ("id", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("index", pa.int32()), ("node_to", pa.int32()),
    ("text_from", pa.int32()), ("text_to", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("zones", pa.list_(pa.string()))]))
_TEXTS = pa.list_(pa.struct([("pos", pa.int32()), ("text", pa.string()), ("zones", pa.list_(pa.string()))]))


# Text up to a tag as pages usually write them, a comment or a document type; all else is left to the standard parser.
_TOKEN = re.compile(
    r"""([^<]*+)<(?:(/)?([a-zA-Z][a-zA-Z0-9]*+)((?:[ \t\n\r\f]++[a-zA-Z_:@][^\s/=>"'<]*+"""
    r"""(?:=(?:"[^"]*+"|'[^']*+'|[^\s"'>=][^\s>]*+))?)*+)[ \t\n\r\f]*+(/)?>|!--.*?--\s*>|!(?i:doctype)[^>]*+>)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=]+)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'>=][^\s>]*)))?""")
_END_OF = {tag: re.compile(rf"</\s*{tag}\s*>", re.IGNORECASE) for tag in HTMLParser.CDATA_CONTENT_ELEMENTS}


class _Flattener(HTMLParser):
    """Numbers elements and strings of pages in document order and notes where elements end.

    What is found is kept in one list per column, page after page, so no object
    stands for a node. ``zones`` are numbers of lists in ``zone_lists``.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.id, self.last, self.parent, self.node_to = [], [], [], []
        self.text_from, self.text_to, self.tag, self.zones, self.index = [], [], [], [], []
        self.names, self.values, self.attrs_from = [], [], [0]
        self.pos, self.text, self.text_zones = [], [], []
        self.nodes_from, self.texts_from = [0], [0]
        self.zone_lists: list[list[str]] = [[]]
        self.inner: dict[tuple[int, str], int] = {}
        # Of the open elements: their numbers in the page, tags and the zones inside them.
        self.open: list[int] = []
        self.open_tags: list[str] = []
        self.open_zones: list[int] = [0]
        self.position = 0

    def _close(self, depth: int) -> None:
        first, nodes = self.nodes_from[-1], len(self.id) - self.nodes_from[-1]
        texts = len(self.pos) - self.texts_from[-1]
        for index in self.open[depth:]:
            self.last[first + index] = self.position
            self.node_to[first + index] = nodes
            self.text_to[first + index] = texts
        del self.open[depth:], self.open_tags[depth:], self.open_zones[depth + 1:]

    def _end_open(self, tags: set[str], limits: set[str]) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.open_tags[depth]
            if tag in tags:
                return self._close(depth)
            if tag in limits:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES:
            self._end_open(*_CLOSES[tag])
        if tag in _BLOCKS:
            self._end_open({"p"}, _P_LIMITS)
        self.position += 1
        index, texts = len(self.id) - self.nodes_from[-1], len(self.pos) - self.texts_from[-1]
        zone = self.open_zones[-1]
        if attrs:
            values: dict[str, str] = {}
            for name, value in attrs:
                values.setdefault(name, value or "")
            self.names.extend(values)
            self.values.extend(values.values())
        self.attrs_from.append(len(self.names))
        self.id.append(self.position)
        self.last.append(self.position)
        self.parent.append(self.open[-1] if self.open else -1)
        self.index.append(index)
        self.node_to.append(index + 1)
        self.text_from.append(texts)
        self.text_to.append(texts)
        self.tag.append(tag)
        self.zones.append(zone)
        if tag not in _VOID:
            self.open.append(index)
            self.open_tags.append(tag)
            self.open_zones.append(self._zone_inside(zone, tag) if tag in _ZONES else zone)

    def _zone_inside(self, zone: int, tag: str) -> int:
        if (zone, tag) not in self.inner:
            outer = self.zone_lists[zone]
            if tag in outer:
                self.inner[zone, tag] = zone
            else:
                self.inner[zone, tag] = len(self.zone_lists)
                self.zone_lists.append([*outer, tag])
        return self.inner[zone, tag]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open_tags[depth] == tag:
                return self._close(depth)
        return None

    def handle_data(self, data):
        self.position += 1
        self.pos.append(self.position)
        self.text.append(data)
        self.text_zones.append(self.open_zones[-1])

    def _tokens(self, html: str) -> int:
        """Handle all up to the first thing that only the standard parser reads; gives its place, or the end."""
        at, match = 0, _TOKEN.match
        while token := match(html, at):
            text, ending, tag, attrs, empty = token.groups()
            after = token.end()
            raw = None
            if tag:
                if ending and (attrs or empty):
                    return at
                tag = tag.lower()
                if tag in _END_OF and not ending and not empty:
                    raw = _END_OF[tag].search(html, after)
                    if raw is None:
                        return at
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            if ending:
                self.handle_endtag(tag)
            elif tag:
                self.handle_starttag(tag, [
                    (name.lower(), unescape(value) if "&" in value else value)
                    for name, a, b, c in _ATTRIBUTE.findall(attrs) for value in [a or b or c]] if attrs else ())
            if raw:
                if raw.start() > after:
                    self.handle_data(html[after:raw.start()])
                self.handle_endtag(tag)
                after = raw.end()
            at = after
        return at

    def add(self, html: str) -> None:
        """One more page."""
        at = self._tokens(html)
        if at < len(html):
            self.reset()
            self.feed(html[at:])
            self.close()
        self._close(0)
        self.position = 0
        self.nodes_from.append(len(self.id))
        self.texts_from.append(len(self.pos))

    def columns(self) -> tuple[pa.Array, pa.Array]:
        """``nodes`` and ``texts`` of the pages."""
        zones = pa.array(self.zone_lists, pa.list_(pa.string()))
        whole = [pa.array(x, pa.int32()) for x in (
            self.id, self.last, self.parent, self.index, self.node_to, self.text_from, self.text_to)]
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attrs_from, pa.int32()), pa.array(self.names, pa.string()), pa.array(self.values, pa.string()))
        nodes = pa.StructArray.from_arrays(
            [*whole, pa.array(self.tag, pa.string()), attrs, zones.take(pa.array(self.zones, pa.int32()))],
            fields=list(_NODES.value_type))
        texts = pa.StructArray.from_arrays(
            [pa.array(self.pos, pa.int32()), pa.array(self.text, pa.string()), zones.take(pa.array(self.text_zones, pa.int32()))],
            fields=list(_TEXTS.value_type))
        return (pa.ListArray.from_arrays(pa.array(self.nodes_from, pa.int32()), nodes),
                pa.ListArray.from_arrays(pa.array(self.texts_from, pa.int32()), texts))


# Characters of markup whose nodes are held at once; a longer page is held alone.
_MARKUP_AT_ONCE = 2_000_000


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` characters each, one row at least."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _flatten_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [name for name in batch.schema.names if name != "html"]
        markup = batch.column("html")
        for start, stop in _runs([size or 0 for size in pc.utf8_length(markup).to_pylist()], _MARKUP_AT_ONCE):
            flat = _Flattener()
            for html in markup.slice(start, stop - start).to_pylist():
                flat.add(html or "")
            kept = [batch.column(name).slice(start, stop - start) for name in names]
            yield pa.RecordBatch.from_arrays([*kept, *flat.columns()], names=[*names, "nodes", "texts"])


def flatten_pages(pages: DataFrame, html: str = "html", partitions: int | None = None) -> DataFrame:
    """Pages with ``nodes`` and ``texts`` instead of markup; other columns pass through.

    ``partitions`` spreads pages first, for input in few large unsplittable
    files; by default the scan's own splits are kept and nothing is shuffled.
    """
    named = pages.withColumnRenamed(html, "html")
    if partitions:
        named = named.repartition(partitions)
    passed = [f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema if f.name != "html"]
    return named.mapInArrow(_flatten_batches, ", ".join([*passed, DOM_SCHEMA]))


_REMOVED_FOR_SEO = ("script", "style", "nav", "footer", "header")
_REMOVED_FOR_CONTENT = (*_REMOVED_FOR_SEO, "aside", "form")


def _outside(texts: Column, *zones: str) -> Column:
    return F.filter(texts, lambda t: ~dom.in_zone(t, *zones))


def visible_text(texts: Column) -> Column:
    return dom.joined(_outside(texts, *dom.RAW_TEXT), " ")


def seo_body_text(texts: Column) -> Column:
    return dom.joined(_outside(texts, *_REMOVED_FOR_SEO), " ")


def report_body_text(texts: Column) -> Column:
    """Text of the body, navigation included."""
    return dom.joined(_outside(texts, *dom.RAW_TEXT, "head", "title"), " ")


def main_content(nodes: Column, texts: Column) -> Column:
    """Text of main, else article, else the content id or class, else the whole page; chrome removed."""
    def kept(condition):
        return lambda n: condition(n) & ~dom.in_zone(n, *_REMOVED_FOR_CONTENT) & ~n["tag"].isin(
            *_REMOVED_FOR_CONTENT)

    area = F.coalesce(*[dom.first(F.filter(nodes, kept(c))) for c in (
        dom.tag_in("main"), dom.tag_in("article"),
        lambda n: F.coalesce(dom.attr(n, "id") == "content", F.lit(False)),
        lambda n: dom.has_token(dom.attr(n, "class"), "content"))])
    clean = _outside(texts, *_REMOVED_FOR_CONTENT)
    return let(area, lambda a: dom.joined(
        F.filter(clean, lambda t: a.isNull() | dom.covers(a, t["pos"])), " "))


def _meta(nodes: Column) -> Column:
    return F.transform(dom.tagged(nodes, "meta"), lambda n: F.struct(
        F.coalesce(dom.attr(n, "name"), F.lit("")).alias("name"),
        F.coalesce(dom.attr(n, "property"), F.lit("")).alias("property"),
        F.coalesce(dom.attr(n, "content"), F.lit("")).alias("content")))


def _headings(nodes: Column, texts: Column) -> Column:
    return F.transform(dom.tagged(nodes, "h1", "h2", "h3"), lambda n: F.struct(
        n["tag"].alias("tag"), dom.text_of(texts, n).alias("text")))


def _linked(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: (n["tag"] == "a") & dom.attr(n, "href").isNotNull())


def _anchors(nodes: Column) -> Column:
    return F.transform(_linked(nodes), lambda n: F.struct(
        dom.attr(n, "href").alias("href"),
        dom.has_token(dom.attr(n, "rel"), "nofollow").alias("nofollow"),
        dom.in_zone(n, *_REMOVED_FOR_SEO).alias("in_chrome")))


def _images(nodes: Column) -> Column:
    return F.transform(dom.tagged(nodes, "img"), lambda n: F.struct(
        F.coalesce(dom.attr(n, "alt") != "", F.lit(False)).alias("has_alt"),
        F.coalesce(dom.attr(n, "loading") == "lazy", F.lit(False)).alias("lazy"),
        dom.in_zone(n, *_REMOVED_FOR_SEO).alias("in_chrome")))


def _scripts(nodes: Column) -> Column:
    def given(n: Column, name: str) -> Column:
        # An attribute without a value does not count, as in the results to match.
        return F.coalesce(dom.attr(n, name) != "", F.lit(False))

    return F.transform(dom.tagged(nodes, "script"), lambda n: F.struct(
        given(n, "src").alias("external"), (given(n, "async") | given(n, "defer")).alias("deferred"),
        F.coalesce(dom.attr(n, "type"), F.lit("")).alias("type")))


def _microdata(nodes: Column, texts: Column) -> Column:
    scoped = F.filter(nodes, lambda n: dom.attr(n, "itemscope").isNotNull()
                      & F.coalesce(dom.attr(n, "itemtype") != "", F.lit(False)))
    return F.transform(scoped, lambda n: F.struct(
        F.substring_index(dom.attr(n, "itemtype"), "/", -1).alias("type"),
        F.transform(dom.under(nodes, n, lambda d: dom.attr(d, "itemprop").isNotNull()), lambda d: F.struct(
            dom.attr(d, "itemprop").alias("name"),
            F.coalesce(F.nullif(dom.attr(d, "content"), F.lit("")), dom.text_of(texts, d)).alias("value")))
        .alias("properties")))


def extract_page_facts(pages: DataFrame, html: str = "html", partitions: int | None = None) -> DataFrame:
    """One row per page with every fact the scoring operators read.

    Unused facts are pruned by Catalyst; texts of links and bodies of scripts stand in
    columns of their own (``anchor_texts``, ``script_bodies``, in the order of
    ``anchors`` and ``scripts``), so they are only built when read. Save the result
    when several operators follow, so that markup is parsed once.
    """
    sized = pages.withColumn("page_bytes", F.octet_length(html))
    flat = flatten_pages(sized, html, partitions)
    nodes, texts = F.col("nodes"), F.col("texts")
    title = dom.first(dom.tagged(nodes, "title"))
    return flat.select(
        *[c for c in flat.columns if c not in ("nodes", "texts")],
        F.coalesce(let(title, lambda n: F.when(n.isNotNull(), dom.raw_text_of(texts, n))), F.lit("")).alias("title"),
        _meta(nodes).alias("meta"),
        _headings(nodes, texts).alias("headings"),
        _anchors(nodes).alias("anchors"),
        F.transform(_linked(nodes), lambda n: dom.text_of(texts, n)).alias("anchor_texts"),
        _images(nodes).alias("images"),
        _scripts(nodes).alias("scripts"),
        F.transform(dom.tagged(nodes, "script"), lambda n: dom.raw_text_of(texts, n)).alias("script_bodies"),
        F.transform(dom.tagged(nodes, "link"), lambda n: F.coalesce(dom.attr(n, "rel"), F.lit(""))).alias("link_rels"),
        F.size(dom.tagged(nodes, "style")).alias("inline_styles"),
        _microdata(nodes, texts).alias("microdata"),
        visible_text(texts).alias("visible_text"),
        main_content(nodes, texts).alias("main_text"),
        seo_body_text(texts).alias("seo_text"),
        report_body_text(texts).alias("body_text"),
    )


# --- columns over page facts ---------------------------------------------------------------


def meta_description(meta: Column) -> Column:
    return F.coalesce(dom.first(F.filter(meta, lambda m: m["name"] == "description"))["content"], F.lit(""))


def heading_count(headings: Column, tag: str) -> Column:
    return F.size(F.filter(headings, lambda h: h["tag"] == tag))


def heading_text(headings: Column, tag: str) -> Column:
    return F.array_join(F.transform(F.filter(headings, lambda h: h["tag"] == tag), lambda h: h["text"]), " ")


def first_heading(headings: Column, tag: str) -> Column:
    return dom.first(F.filter(headings, lambda h: h["tag"] == tag))["text"]


def _count(array: Column, condition) -> Column:
    return F.size(F.filter(array, condition))


def title_and_meta(facts: DataFrame) -> DataFrame:
    description = meta_description(F.col("meta"))
    return facts.withColumns({
        "title_length": F.length("title"), "meta_description_length": F.length(description),
        "meta_description": F.substring(description, 1, 2000), "title": F.substring("title", 1, 512)})


def heading_counts(facts: DataFrame) -> DataFrame:
    return facts.withColumns({
        **{f"{tag}_count": heading_count(F.col("headings"), tag) for tag in ("h1", "h2", "h3")},
        "h1_content": F.substring(first_heading(F.col("headings"), "h1"), 1, 500)})


def link_counts(facts: DataFrame, whole_page: bool = False) -> DataFrame:
    """Internal and external links; those in navigation, header and footer only with ``whole_page``."""
    base = F.concat(urls.scheme(F.col("url")), F.lit("://"), F.regexp_extract("url", urls.URI, 2))

    def counted(b: Column) -> Column:
        def internal(a: Column) -> Column:
            return a["href"].startswith("/") | F.startswith(a["href"], b)

        def seen(a: Column) -> Column:
            return F.lit(True) if whole_page else ~a["in_chrome"]

        return F.struct(
            _count(F.col("anchors"), lambda a: seen(a) & internal(a)).alias("internal"),
            _count(F.col("anchors"), lambda a: seen(a) & ~internal(a) & a["href"].startswith("http"))
            .alias("external"))

    return facts.withColumn("_links", let(base, counted)).withColumns({
        "internal_links": F.col("_links.internal"), "external_links": F.col("_links.external")}).drop("_links")


def image_counts(facts: DataFrame, whole_page: bool = False) -> DataFrame:
    shown = F.col("images") if whole_page else F.filter("images", lambda i: ~i["in_chrome"])
    return facts.withColumns({"images_count": F.size(shown), "images_with_alt": _count(shown, lambda i: i["has_alt"])})


def has_rel(rels: Column, token: str) -> Column:
    return F.exists(rels, lambda r: dom.has_token(r, token))


def json_ld(scripts: Column, bodies: Column) -> Column:
    return F.filter(bodies, lambda b, i: F.get(scripts, i)["type"] == "application/ld+json")


def technical_flags(facts: DataFrame, site_files: DataFrame) -> DataFrame:
    """Scheme, canonical, JSON-LD, and whether the site answered for its sitemap and robots file.

    ``site_files``: host, path, status. It is folded to one row per host first.
    """
    answered = site_files.filter(F.col("status") == 200).groupBy("host").agg(
        F.max(F.col("path") == "/sitemap.xml").alias("has_sitemap"),
        F.max(F.col("path") == "/robots.txt").alias("has_robots"))
    flagged = facts.withColumns({
        "host": urls.host(F.col("url")), "has_ssl": urls.scheme(F.col("url")) == "https",
        "has_canonical": has_rel(F.col("link_rels"), "canonical"),
        "has_schema": F.exists("scripts", lambda s: s["type"] == "application/ld+json")})
    no = F.lit(False)
    return flagged.join(answered, "host", "left").withColumns({
        "has_sitemap": F.coalesce("has_sitemap", no), "has_robots": F.coalesce("has_robots", no)})


def extract_links(facts: DataFrame, key: str = "page_id", same_domain_only: bool = True) -> DataFrame:
    """Distinct links of each page in normal form; the first mention gives text and nofollow.

    All inside the page's own row: no shuffle.
    """
    named = F.transform("anchors", lambda a, i: F.struct(
        a["href"].alias("href"), a["nofollow"].alias("nofollow"), F.get("anchor_texts", i).alias("text")))
    usable = F.filter(named, lambda a: (dom.strip(a["href"]) != "") & ~dom.strip(a["href"]).rlike(
        r"^(?:javascript:|mailto:|tel:|#)"))
    normal = F.transform(usable, lambda a, i: F.struct(
        urls.normalize_url(dom.strip(a["href"]), F.col("url")).alias("link"), i.alias("pos"),
        F.substring(a["text"], 1, 200).alias("text"), a["nofollow"].alias("nofollow")))
    distinct = let(F.array_sort(normal), lambda rows: F.filter(
        rows, lambda r, i: (i == 0) | (r["link"] != F.get(rows, i - 1)["link"])))
    links = unnest(facts, [key, F.col("url").alias("page_url")], distinct, "l").select(
        key, "l.pos", F.col("l.link").alias("url"), "l.text", "l.nofollow",
        urls.same_host(F.col("l.link"), F.col("page_url")).alias("is_internal"))
    links = links.filter(~urls.skipped_file(F.col("url"))).withColumns({
        "type": urls.link_type(F.col("url")), "depth": urls.url_depth(F.col("url"))})
    return links.filter("is_internal") if same_domain_only else links


def _first(array: Column, n: int | None) -> Column:
    return array if n is None else F.slice(array, 1, n)


def crawl_links(facts: DataFrame, key: str = "page_id", n: int | None = None) -> DataFrame:
    """The crawler's loose link list: absolute http links in page order, all or the first ``n``."""
    absolute = F.transform("anchors", lambda a: F.when(
        a["href"].startswith("/"), urls.resolve(a["href"], F.col("url"))).otherwise(a["href"]))
    kept = _first(F.filter(absolute, lambda u: u.startswith("http")), n)
    return unnest(facts, [key], kept, "link", "pos")


def _ld_items(body: Column, pos: Column) -> Column:
    """Items of one JSON-LD body: its graph, its list, or itself."""
    def item(v: Column) -> Column:
        kind = F.coalesce(
            F.try_variant_get(v, '$["@type"][0]', "string"), F.try_variant_get(v, '$["@type"]', "string"),
            F.lit("Unknown"))
        return F.struct(
            F.lit("json-ld").alias("source"), pos.alias("pos"), kind.alias("type"),
            F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>")).alias("properties"),
            F.lit(True).alias("is_valid"))

    broken = F.array(F.struct(
        F.lit("json-ld").alias("source"), pos.alias("pos"), F.lit("Invalid").alias("type"),
        F.array().cast("array<string>").alias("properties"), F.lit(False).alias("is_valid")))
    return let(F.try_parse_json(body), lambda v: F.when(v.isNull(), broken).otherwise(F.transform(F.coalesce(
        F.try_variant_get(v, '$["@graph"]', "array<variant>"), F.try_variant_get(v, "$", "array<variant>"),
        F.array(v)), item)))


def schema_item_array(facts: DataFrame) -> Column:
    """Structured-data items of a page: JSON-LD in page order, then microdata."""
    bodies = F.filter(json_ld(F.col("scripts"), F.col("script_bodies")), lambda b: b != "")
    micro = F.transform("microdata", lambda m, i: F.struct(
        F.lit("microdata").alias("source"), i.alias("pos"), m["type"].alias("type"),
        F.array_distinct(F.transform(m["properties"], lambda p: p["name"])).alias("properties"),
        F.lit(True).alias("is_valid")))
    return F.concat(F.flatten(F.transform(bodies, _ld_items)), micro)


def schema_items(facts: DataFrame, key: str = "page_id") -> DataFrame:
    """Structured-data items, one row each. A body that is not JSON gives one ``Invalid`` item."""
    return unnest(facts, [key], schema_item_array(facts), "item", "item_pos").select(
        key, "item_pos", "item.*")


def microdata_items(facts: DataFrame, key: str = "page_id") -> DataFrame:
    return schema_items(facts, key).filter("source = 'microdata'")


def microdata_values(facts: DataFrame, key: str = "page_id") -> DataFrame:
    """Property values of microdata items, one row each; the last value of a name wins."""
    rows = unnest(facts, [key], "microdata", "m", "pos").select(
        key, "pos", F.col("m.type").alias("type"), "m.properties")
    last = F.filter("properties", lambda p, i: ~F.exists(
        F.slice(F.col("properties"), i + 2, F.size("properties")), lambda q: q["name"] == p["name"]))
    return unnest(rows, [key, "pos", "type"], last, "p").select(
        key, "pos", "type", F.col("p.name").alias("name"), F.col("p.value").alias("value"))


def _last_wins(pairs: Column) -> Column:
    """Map of name to last value."""
    return F.aggregate(
        pairs, F.expr("cast(map() as map<string,string>)"),
        lambda done, p: F.map_concat(F.map_filter(done, lambda k, _: k != p["name"]),
                                     F.create_map(p["name"], p["value"])))


def open_graph(meta: Column) -> Column:
    tags = F.filter(meta, lambda m: m["property"].startswith("og:"))
    return _last_wins(F.transform(tags, lambda m: F.struct(
        m["property"].alias("name"), m["content"].alias("value"))))


def twitter_tags(meta: Column) -> Column:
    tags = F.filter(meta, lambda m: m["name"].startswith("twitter:") & ~m["property"].startswith("og:"))
    return _last_wins(F.transform(tags, lambda m: F.struct(m["name"].alias("name"), m["content"].alias("value"))))


def social_tags(facts: DataFrame) -> DataFrame:
    return facts.withColumns({"open_graph": open_graph(F.col("meta")), "twitter": twitter_tags(F.col("meta"))})


def page_resources(facts: DataFrame) -> DataFrame:
    external = F.filter("scripts", lambda s: s["external"])
    return facts.withColumns({
        "external_scripts": F.size(external),
        "inline_scripts": _count(F.col("script_bodies"), lambda b: F.length(b) > 100),
        "stylesheets": _count(F.col("link_rels"), lambda r: dom.has_token(r, "stylesheet")),
        "page_images": F.size("images"), "lazy_images": _count(F.col("images"), lambda i: i["lazy"]),
        "has_async_scripts": F.exists(external, lambda s: s["deferred"]),
        "has_preload": has_rel(F.col("link_rels"), "preload"),
        "has_preconnect": has_rel(F.col("link_rels"), "preconnect")})


def ingest_page_snapshots(fetches: DataFrame, html: str = "html", markup_chars: int | None = None,
                          links: int | None = None) -> DataFrame:
    """Fetched pages as snapshot rows: title, text hash and size, stored markup, links.

    ``markup_chars`` and ``links`` keep so much of each page's markup and so many of
    its links; by default all.
    """
    markup = F.col(html) if markup_chars is None else F.substring(html, 1, markup_chars)
    stored = fetches.withColumn("html_content", markup)
    facts = extract_page_facts(stored, html)
    absolute = F.transform("anchors", lambda a: F.when(
        a["href"].startswith("/"), urls.resolve(a["href"], F.col("url"))).otherwise(a["href"]))
    return facts.select(
        *[c for c in fetches.columns if c != html], F.nullif(F.substring("title", 1, 500), F.lit("")).alias("title"),
        F.lit("text/html").alias("content_type"), F.sha2("visible_text", 256).alias("content_hash"),
        tx.word_count(F.col("visible_text")).alias("word_count"), "html_content",
        _first(F.filter(absolute, lambda u: u.startswith("http")), links).alias("links"))


# --- prices and products on pages ------------------------------------------------------------

# What marks a price element (class parts in the order they are looked for).
PRICE_CLASSES_FIRST = ["price", "Price", "cost", "amount"]
PRICE_CLASSES_LAST = ["plan", "Plan", "tier", "Tier", "pricing", "Pricing", "subscription", "package", "fee",
                      "rate"]


def _has_class_part(n: Column, part: str) -> Column:
    return F.coalesce(F.contains(dom.attr(n, "class"), F.lit(part)), F.lit(False))


def _first_rule(rules: list[Column]) -> Column:
    chain = F
    for i, rule in enumerate(rules):
        chain = chain.when(rule, i)
    return chain.otherwise(F.lit(None).cast("int"))


def _price_rule(n: Column) -> Column:
    return _first_rule([
        *[_has_class_part(n, p) for p in PRICE_CLASSES_FIRST],
        dom.attr(n, "data-price").isNotNull(), F.coalesce(dom.attr(n, "itemprop") == "price", F.lit(False)),
        *[_has_class_part(n, p) for p in PRICE_CLASSES_LAST]])


def _ancestors(nodes: Column, node: Column, n: int) -> Column:
    """Up to ``n`` enclosing nodes, nearest first."""
    steps = F.sequence(F.lit(1), F.lit(n))
    start = F.struct(node["parent"].alias("next"), F.expr("cast(array() as array<int>)").alias("found"))
    walked = F.aggregate(steps, start, lambda acc, _: F.when(
        acc["next"] >= 0, F.struct(F.get(nodes, acc["next"])["parent"].alias("next"),
                                   F.array_append(acc["found"], acc["next"]).alias("found"))).otherwise(acc))
    return F.transform(walked["found"], lambda i: F.get(nodes, i))


_RANGE = ("id", "last", "index", "node_to", "text_from", "text_to")


def _ranged(n: Column) -> list[Column]:
    """The fields of a node that say what it covers."""
    return [n[f].alias(f) for f in _RANGE]


def _product_name(nodes: Column, texts: Column, headings: Column, titled: Column, node: Column) -> Column:
    """Nearest heading, else product-like class, within five enclosing elements.

    ``headings`` and ``titled`` are the page's few candidates. Enclosing elements
    are tried one after another, and the first with a name ends the search.
    """
    def name_in(a: Column) -> Column:
        def within(candidates: Column) -> Column:
            return dom.first(F.filter(candidates, lambda n: dom.covers(a, n["id"])))

        return let(within(headings), lambda h: F.when(
            h.isNotNull(), F.substring(dom.text_of(texts, h), 1, 200)).otherwise(
            let(within(titled), lambda t: let(dom.text_of(texts, t), lambda s: F.when(
                t.isNotNull() & (F.length(s) > 2) & (F.length(s) < 200), s)))))

    return let(_ancestors(nodes, node, 5), lambda up: F.coalesce(*[
        let(F.get(up, F.lit(k)), lambda a: F.when(a.isNotNull(), name_in(a))) for k in range(5)]))


def price_mentions(pages: DataFrame, key: str = "page_id", mode: str = "first",
                   partitions: int | None = None) -> DataFrame:
    """Prices shown on pages with product name, currency, original price and discount.

    Elements with equal text count once per page. ``mode`` is that of
    :func:`marketlens.functions.prices.extract_price_values`.
    """
    flat = flatten_pages(pages.select(key, "url", "html"), partitions=partitions)
    nodes, texts = F.col("nodes"), F.col("texts")
    candidates = {
        "_headings": F.filter(nodes, dom.tag_in("h1", "h2", "h3", "h4", "h5")),
        "_titled": F.filter(nodes, dom.class_like("title|name|product"))}
    flat = flat.withColumns({name: F.transform(found, lambda n: F.struct(*_ranged(n))) for name, found in candidates.items()})
    # Text is only built for marked nodes: filter first, then transform.
    marked = F.transform(F.filter(nodes, lambda n: _price_rule(n).isNotNull()), lambda n: F.struct(
        dom.text_of(texts, n).alias("text"), _price_rule(n).alias("rule"), n["id"].alias("id"),
        n["parent"].alias("parent")))
    distinct = let(F.array_sort(marked), lambda rows: F.filter(
        rows, lambda r, i: (i == 0) | (r["text"] != F.get(rows, i - 1)["text"])))
    priced = F.filter(
        F.transform(distinct, lambda c: F.struct(c.alias("c"), extract_price_values(c["text"], mode).alias("prices"))),
        lambda c: F.size(c["prices"]) > 0)

    def about(place: Column) -> Column:
        """What the enclosing element says of its prices; worked out once for all of them."""
        parent = F.get(nodes, F.when(place >= 0, place))
        strike = dom.first_under(nodes, parent, dom.tag_in("s", "strike", "del"), dom.class_like("original|was|old"))
        shown = F.array_join(F.transform(F.filter(dom.texts_under(texts, parent), lambda t: ~dom.in_zone(
            t, *dom.RAW_TEXT)), lambda t: t["text"]), "")
        struck = let(strike, lambda s: F.when(s.isNotNull(), dom.raw_text_of(texts, s)))
        original = let(struck, lambda s: F.when(s.isNotNull(), normalize_price(F.get(first_price_text(s), F.lit(0)))))
        worded = let(shown, lambda around: F.coalesce(*[
            F.nullif(F.regexp_extract(around, f"(?i){p}", 1), F.lit("")) for p in DISCOUNT_PATTERNS]).try_cast("int"))
        return F.struct(
            _product_name(nodes, texts, F.col("_headings"), F.col("_titled"), F.struct(place.alias("parent"))).alias("name"),
            F.nullif(original, F.lit(0).cast("decimal(12,2)")).alias("original_price"), worded.alias("worded"))

    def with_places(found: Column) -> Column:
        places = F.array_distinct(F.transform(found, lambda c: c["c"]["parent"]))
        return let(let(places, lambda p: F.map_from_arrays(p, F.transform(p, about))), lambda known: F.transform(
            found, lambda c: F.struct(
                c["c"]["id"].alias("element"), c["c"]["text"].alias("text"), c["prices"].alias("prices"),
                F.element_at(known, c["c"]["parent"]).alias("about"))))

    shown = unnest(flat, [key, "url"], let(priced, with_places), "m").select(
        key, "url", "m.element", "m.text", "m.prices", "m.about.*")
    rows = unnest(shown, ["*"], "prices", "price", "pos")
    saved = sale_from_original(F.col("price"), F.col("original_price"))
    return rows.select(
        key, "element", "pos",
        F.coalesce("name", F.concat(F.lit("Product on "), "url")).alias("product_name"), "price", "original_price",
        detect_currency(F.col("text")).alias("currency"),
        (saved.isNotNull() | F.col("worded").isNotNull()).alias("is_on_sale"),
        F.coalesce("worded", saved).alias("discount_percent"), F.col("url").alias("source_url"))


def _card_rule(n: Column) -> Column:
    return _first_rule([
        _has_class_part(n, "product"), _has_class_part(n, "Product"),
        F.coalesce(F.contains(dom.attr(n, "itemtype"), F.lit("Product")), F.lit(False)),
        dom.attr(n, "data-product").isNotNull(), (n["tag"] == "article") & _has_class_part(n, "card")])


def _features(nodes: Column, texts: Column, card: Column) -> Column:
    lists = dom.under(nodes, card, lambda n: n["tag"].isin("ul", "ol") & dom.class_like("feature|spec|benefit")(n))
    general = F.filter(F.flatten(F.transform(lists, lambda l: F.transform(
        dom.under(nodes, l, dom.tag_in("li")), lambda i: F.struct(
            dom.text_of(texts, i).alias("name"), F.lit(None).cast("string").alias("value"),
            F.lit("general").alias("category"))))), lambda f: F.length(f["name"]) > 2)
    general = F.transform(general, lambda f: F.struct(
        F.substring(f["name"], 1, 250).alias("name"), f["value"].alias("value"), f["category"].alias("category")))
    tables = dom.under(nodes, card, lambda n: (n["tag"] == "table") & dom.class_like("spec|feature|detail")(n))
    rows = F.flatten(F.transform(tables, lambda t: F.transform(
        dom.under(nodes, t, dom.tag_in("tr")), lambda r: dom.under(nodes, r, dom.tag_in("td", "th")))))
    specs = F.transform(F.filter(rows, lambda cells: F.size(cells) >= 2), lambda cells: F.struct(
        F.substring(dom.text_of(texts, F.get(cells, F.lit(0))), 1, 250).alias("name"),
        F.substring(dom.text_of(texts, F.get(cells, F.lit(1))), 1, 500).alias("value"),
        F.lit("specification").alias("category")))
    return F.concat(general, specs)


def extract_products(pages: DataFrame, key: str = "page_id", partitions: int | None = None,
                     features: int | None = None) -> DataFrame:
    """Product cards of each page, the first one of every name, with all their features or the first ``features``."""
    flat = flatten_pages(pages.select(key, "url", "html"), partitions=partitions)
    nodes, texts = F.col("nodes"), F.col("texts")

    def named(n: Column) -> Column:
        name = dom.first_under(nodes, n, dom.tag_in("h1", "h2", "h3", "h4"), dom.class_like("name|title"))
        return F.struct(
            let(name, lambda e: F.when(e.isNotNull(), dom.text_of(texts, e))).alias("name"),
            _card_rule(n).alias("rule"), *_ranged(n))

    cards = F.filter(F.transform(F.filter(nodes, lambda n: _card_rule(n).isNotNull()), named),
                     lambda c: F.length(c["name"]) >= 2)
    distinct = let(F.array_sort(cards), lambda rows: F.filter(
        rows, lambda r, i: (i == 0) | (r["name"] != F.get(rows, i - 1)["name"])))

    def text_at(n: Column, pattern: str) -> Column:
        return let(dom.first(dom.under(nodes, n, dom.class_like(pattern))),
                   lambda e: F.when(e.isNotNull(), dom.text_of(texts, e)))

    def details(c: Column) -> Column:
        href = dom.attr(dom.first(dom.under(nodes, c, lambda n: (n["tag"] == "a") & dom.attr(n, "href").isNotNull())),
                        "href")
        image = dom.first(dom.under(nodes, c, dom.tag_in("img")))
        gone = F.exists(dom.texts_under(texts, c), lambda t: t["text"].rlike("(?i)out of stock|unavailable|sold out"))
        return F.struct(
            c["rule"].alias("rule"), c["id"].alias("element"), F.substring(c["name"], 1, 500).alias("name"),
            F.when(href.startswith("/"), urls.resolve(href, F.col("url"))).when(href.startswith("http"), href)
            .otherwise(F.col("url")).alias("product_url"),
            F.substring(text_at(c, "desc|summary|excerpt"), 1, 1000).alias("description"),
            text_at(c, "category|cat|type").alias("category"),
            F.coalesce(F.nullif(dom.attr(image, "src"), F.lit("")), dom.attr(image, "data-src")).alias("image_url"),
            (~gone).alias("is_available"), _first(_features(nodes, texts, c), features).alias("features"))

    return unnest(flat, [key], F.transform(distinct, details), "p").select(
        key, "p.element", "p.name", F.col("p.product_url").alias("url"), "p.description",
        F.substring("p.description", 1, 200).alias("short_description"), "p.category", "p.image_url",
        "p.is_available", "p.features")


def extract_product_features(products: DataFrame, *keys: str) -> DataFrame:
    """Features of product cards, one row each, in page order."""
    return unnest(products, keys, "features", "f", "pos").select(
        *keys, "pos", F.col("f.name").alias("feature_name"), F.col("f.value").alias("feature_value"),
        F.col("f.category").alias("feature_category"))

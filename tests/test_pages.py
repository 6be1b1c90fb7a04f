import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlens.functions import scores as sc
from marketlens.operators import html as h
from marketlens.operators import seo
from marketlens.sources import site_files

PAGE = """<!DOCTYPE html><html><head><title>Shop &amp; more</title><meta name="description" content="d&quot;">
<meta property="og:title" content="a"><meta property="og:title" content="b"><meta name="twitter:card" content="summary">
<link rel="stylesheet preload" href="x"><script src="a.js" async="async"></script><script async src="b.js"></script>
<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"x"},{"@type":["A","B"]}]}</script>
<script type="application/ld+json">nope</script><script type="application/ld+json">[{"a":1}]</script></head>
<body><nav><a href="/n">n</a><img src="q"></nav><main><h1>Big</h1><h2>Sub</h2>
<a href="../x/./y?b=2&amp;a=1&utm_source=q#f" rel="nofollow me">L</a><a href="mailto:x">m</a><a href="/f.pdf">f</a>
<a href="/w#again">dup</a><img src="a" alt=""><img src="b" alt="z" loading="lazy">
<div class="product card"><h3>Widget</h3><p class="desc">nice <b>thing</b></p>
<div class="box"><span class="price">$99.99</span><s>$120.00</s> 10% off</div><a href="/w">go</a>
<img data-src="i.png"><ul class="features"><li>One<li>Two</ul>
<table class="spec"><tr><td>W</td><td>5</td></tr></table> Sold out</div>
<div class="product"><h4>Widget</h4></div><div class="product"><h4>Gadget</h4><i data-price="1">€1.234,50</i></div>
<div itemscope itemtype="http://schema.org/Offer"><span itemprop="n">v</span><meta itemprop="p" content="c"></div>
</main><footer>foot</footer></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://e.com/a/b", PAGE), (2, "http://f.com/", "<p>only <b>text<p>more"), (3, "http://f.com/x", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def facts(pages):
    return h.extract_page_facts(pages)


def by_id(df):
    return {r["page_id"]: r for r in df.collect()}


def test_texts(facts):
    rows = by_id(facts)
    assert rows[1].title == "Shop & more" and rows[3].title == ""
    assert rows[2].visible_text == "only text more" == rows[2].main_text
    assert "foot" not in rows[1].main_text and rows[1].main_text.startswith("Big Sub L")
    assert "foot" not in rows[1].seo_text and rows[1].seo_text.startswith("Shop & more Big")
    assert rows[1].body_text.startswith("n Big") and rows[1].body_text.endswith("foot")
    assert rows[3].page_bytes == 0


@pytest.mark.parametrize("html,text", [
    ("<article>A</article><main>M</main>", "M"), ("<div id=content>I</div><article>A</article>", "A"),
    ("<div class='x content'>C</div>z<div id='content'>I</div>", "I"), ("<div class='x content'>C</div>z", "C"),
    ("<div class='contents'>C</div>z", "C z"), ("<aside>s</aside><form>f</form>b", "b"),
    ("<nav><main>x</main></nav>y", "y")])
def test_main_content(spark, html, text):
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert h.extract_page_facts(df).first()["main_text"] == text


def test_counts(facts):
    row = by_id(h.image_counts(h.link_counts(h.heading_counts(h.title_and_meta(facts)))))[1]
    assert (row.h1_count, row.h2_count, row.h3_count, row.h1_content) == (1, 1, 1, "Big")
    assert (row.internal_links, row.external_links) == (3, 0)
    assert (row.images_count, row.images_with_alt) == (3, 1)
    assert (row.meta_description, row.meta_description_length) == ('d"', 2)
    whole = by_id(h.image_counts(h.link_counts(facts, whole_page=True), whole_page=True))[1]
    assert (whole.internal_links, whole.images_count) == (4, 4)


def test_links(facts):
    rows = [r for r in h.extract_links(facts).collect() if r.page_id == 1]
    assert {r.url: (r.text, r.nofollow, r.depth) for r in rows} == {
        "https://e.com/n": ("n", False, 1), "https://e.com/x/y?a=1&b=2": ("L", True, 2),
        "https://e.com/w": ("dup", False, 1)}


def test_structured_data(facts):
    items = [(r.source, r.type, r.is_valid) for r in h.schema_items(facts).orderBy("page_id", "item_pos").collect()]
    assert items == [("json-ld", "Product", True), ("json-ld", "A", True), ("json-ld", "Invalid", False),
                     ("json-ld", "Unknown", True), ("microdata", "Offer", True)]
    assert sorted((r.name, r.value) for r in h.microdata_values(facts).collect()) == [("n", "v"), ("p", "c")]


def test_social_and_resources(facts):
    row = by_id(h.page_resources(h.social_tags(facts)))[1]
    assert row.open_graph == {"og:title": "b"} and row.twitter == {"twitter:card": "summary"}
    assert (row.external_scripts, row.stylesheets, row.lazy_images, row.page_images) == (2, 1, 1, 4)
    assert (row.has_async_scripts, row.has_preload, row.has_preconnect) == (True, True, False)


def test_prices(pages):
    rows = {r.product_name: r for r in h.price_mentions(pages).collect()}
    first = rows["Widget"]
    assert (first.price, first.original_price, first.currency) == (Decimal("99.99"), Decimal("120.00"), "USD")
    assert (first.is_on_sale, first.discount_percent) == (True, 10)
    second = rows["Gadget"]
    assert (second.price, second.currency, second.is_on_sale, second.original_price) == (
        Decimal("1234.50"), "EUR", False, None)
    assert len(rows) == 2


def test_products(pages):
    products = h.extract_products(pages)
    rows = {r.name: r for r in products.collect()}
    assert set(rows) == {"Widget", "Gadget"}
    w = rows["Widget"]
    assert (w.url, w.image_url, w.is_available, w.description) == ("https://e.com/w", "i.png", False, "nicething")
    assert rows["Gadget"].url == "https://e.com/a/b" and rows["Gadget"].is_available
    features = h.extract_product_features(products, "name").orderBy("pos").collect()
    assert [(f.feature_name, f.feature_value, f.feature_category) for f in features] == [
        ("One", None, "general"), ("Two", None, "general"), ("W", "5", "specification")]


def test_profile_and_analysis(spark, facts):
    row = by_id(seo.page_profile(facts))[1]
    assert row.schema_markup["count"] == 5 and row.schema_markup["has_priority_schema"]
    assert row.social_meta["missing_required"] == ["og:image", "og:type", "og:url"]
    assert "Fix 1 invalid schema markup(s)" in row.schema_markup["recommendations"]
    assert len(row.recommendations) <= 15
    files = spark.createDataFrame([("e.com", "/robots.txt", 200), ("e.com", "/sitemap.xml", 404)],
                                  "host string, path string, status int")
    analysis = by_id(seo.analyze_pages(facts, files))
    assert (analysis[1].has_robots, analysis[1].has_sitemap, analysis[1].technical_score) == (True, False, 65)
    assert all(0 <= r.overall_score <= 100 for r in analysis.values())


BOUNDS = [(sc.title_score, {0: 0, 1: 40, 29: 40, 30: 60, 40: 80, 49: 80, 50: 100, 60: 100, 61: 80, 70: 80, 71: 60, 81: 40}),
          (sc.meta_description_score, {0: 0, 79: 40, 80: 60, 120: 80, 150: 100, 160: 100, 161: 80, 181: 60, 201: 40}),
          (sc.content_score, {0: 20, 299: 20, 300: 40, 500: 60, 1000: 80, 1500: 90, 2000: 100}),
          (sc.score_status, {49: "error", 50: "warning", 79: "warning", 80: "good"}),
          (sc.score_label, {90: "Excellent", 80: "Great", 70: "Good", 60: "Fair", 50: "Needs Work", 49: "Poor"})]


@pytest.mark.parametrize("score,cases", BOUNDS, ids=[b[0].__name__ for b in BOUNDS])
def test_score_bounds(spark, score, cases):
    df = spark.createDataFrame([(k,) for k in cases], "n int").select("n", score(F.col("n")).alias("s"))
    assert {r.n: r.s for r in df.collect()} == cases


ROBOTS = ("# c\nUser-agent: googlebot\nUser-agent: other\nDisallow: /private # x\nAllow: /private/open\nDisallow: /*.pdf$\n"
          "Crawl-delay: 2.5\nUser-agent: bad\nDisallow: /\nSitemap: https://h/s.xml\nno colon\nDisallow:\n")


def test_robots(spark):
    from marketlens.operators.frontier import robots_allowed

    docs = spark.createDataFrame([("h", ROBOTS), ("empty", "")], "host string, body string")
    rules = site_files.read_robots(docs)
    assert sorted((r.kind, r.pattern) for r in rules.collect()) == [
        ("allow", "/private/open"), ("crawl-delay", "2.5"), ("disallow", "/*.pdf$"), ("disallow", "/private"),
        ("sitemap", "https://h/s.xml")]
    sticky = {(r.kind, r.pattern) for r in site_files.read_robots(docs, sticky=True).collect()}
    assert ("disallow", "/") in sticky
    targets = spark.createDataFrame([(u,) for u in (
        "http://h/private/x", "http://h/private/open/y", "http://h/a.pdf", "http://h/a.pdfx", "http://h", "http://z/q",
        "http://empty/x")], "url string")
    got = {r.url: r.allowed for r in robots_allowed(targets, rules).collect()}
    assert [u for u, ok in got.items() if not ok] == ["http://h/private/x", "http://h/a.pdf"]


def test_sitemaps(spark):
    docs = spark.createDataFrame([
        ("i", '<sitemapindex xmlns="http://x"><sitemap><loc>a</loc></sitemap><sitemap><loc>gone</loc></sitemap></sitemapindex>'),
        ("a", '<urlset xmlns="http://x"><url><loc>u1</loc><priority>0.9</priority><lastmod>2024</lastmod></url>'
              '<url><loc>u2</loc><priority>high</priority></url><url><lastmod>1</lastmod></url></urlset>'),
        ("b", "<urlset><url><loc>u3</loc><changefreq>daily</changefreq></url></urlset>"), ("bad", "<urlset><url>")],
        "url string, body string")
    rows = {(r.root, r.url): (r.priority, r.lastmod, r.changefreq) for r in site_files.read_sitemaps(docs).collect()}
    assert rows == {("i", "u1"): (0.9, "2024", None), ("i", "u2"): (0.5, None, None), ("b", "u3"): (0.5, None, "daily")}
    assert site_files.read_sitemaps(docs, max_urls=1).filter("root = 'i'").count() == 1


def test_usual_markup_reads_as_with_the_standard_parser(monkeypatch):
    """Pages whole and cut anywhere, with odd pieces put in: columns are those of the standard parser alone."""
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<div class=a>", "<div class='b c' id=\"x&amp;y\">", "</div>", "<br/>", "<img src=/a/b/>", "<script>var t='</p>';</script>",
            "<SCRIPT src=x>", "</ script >", "<style>", "</style>", "<!-- a -->", "<!--", "-- >", "<!-->", "<!DOCTYPE html>", "<![CDATA[x]]>", "<?x?>",
            "text", "a &amp; b", "&#65", "&", "<", ">", "</", "</>", "<a href = 'x'>", "<a b=\"1\"c='2'>", "<a =b>", "<a b==c>", "<input disabled a a=2 A=3>",
            "<li>", "</ul>", "<ul>", "<td>", "<tr>", "<nav>", "</nav>", "</p class=x>", "<p/>", "<script/>", "\n", "\x00", "<p\x0bq>", "<a b=\"", "<é>", "<a b=c/>"]
    pages = ["", *["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]]

    def columns():
        flat = h._Flattener()
        for page in pages:
            flat.add(page)
        return flat.columns()

    usual = columns()
    monkeypatch.setattr(h, "_TOKEN", re.compile(r"(?!)"))
    plain = columns()
    assert [c.type for c in usual] == [h._NODES, h._TEXTS]
    assert usual[0].equals(plain[0]) and usual[1].equals(plain[1])

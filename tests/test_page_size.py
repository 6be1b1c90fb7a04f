"""The cost of a page grows with its size, not with its square."""

import time

import pytest
from pyspark.sql import functions as F

from marketlens.operators import html

MAKERS = {
    "anchors": (4000, lambda n: "".join(f'<p><a href="/p{i}">link {i}</a></p>' for i in range(n))),
    "prices": (800, lambda n: "".join(
        f'<div class="card"><h3>Item {i}</h3><div><span class="price">${i + 1}.50</span></div></div>' for i in range(n))),
    "prices_of_one_parent": (2000, lambda n: "<div><h3>All</h3><s>$9999</s> save 10%" + "".join(
        f'<span class="price">${i + 1}.50</span> ' for i in range(n)) + "</div>"),
    "cards": (400, lambda n: "".join(
        f'<div class="product"><h3>Thing {i}</h3><ul class="features"><li>first part</li><li>second part</li></ul></div>'
        for i in range(n))),
    "microdata": (2000, lambda n: "".join(
        f'<div itemscope itemtype="http://schema.org/Thing"><b itemprop="name">n{i}</b></div>' for i in range(n))),
}
RUNS = {
    "anchors": lambda df: html.extract_links(html.extract_page_facts(df)),
    "prices": html.price_mentions,
    "prices_of_one_parent": html.price_mentions,
    "cards": html.extract_products,
    "microdata": lambda df: html.microdata_items(html.extract_page_facts(df)),
}


@pytest.mark.parametrize("kind", sorted(MAKERS))
def test_twice_the_page_costs_about_twice(spark, kind):
    n, make = MAKERS[kind]

    def run(size):
        df = spark.createDataFrame([(1, "https://shop.example/", f"<html><body>{make(size)}</body></html>")],
                                   "page_id long, url string, html string")
        start = time.perf_counter()
        rows = RUNS[kind](df).count()
        return rows, time.perf_counter() - start

    run(n)
    small, large = (min((run(size) for _ in range(3)), key=lambda r: r[1]) for size in (n, 2 * n))
    assert (small[0], large[0]) == (n, 2 * n)
    # Fixed costs are part of both; a quadratic cost would show as 4.
    assert large[1] < 3 * small[1]


def test_more_items_than_a_page_usually_has(spark):
    """Nothing is cut unless asked for: 150 links, 70 features, long markup."""
    links = "".join(f'<a href="https://x.example/{i}">l{i}</a>' for i in range(150))
    parts = "".join(f"<li>feature {i}</li>" for i in range(70))
    markup = f"<html><body>{links}<div class='product'><h3>One</h3><ul class='features'>{parts}</ul></div>{'x' * 120_000}</body></html>"
    df = spark.createDataFrame([(1, "https://x.example/", markup)], "page_id long, url string, html string")
    facts = html.extract_page_facts(df)
    assert html.crawl_links(facts).count() == 150 and html.crawl_links(facts, n=100).count() == 100
    row = html.ingest_page_snapshots(df).select("html_content", F.size("links").alias("n")).first()
    assert (row.html_content, row.n) == (markup, 150)
    row = html.ingest_page_snapshots(df, markup_chars=100_000, links=100).select(
        F.length("html_content").alias("chars"), F.size("links").alias("n")).first()
    assert (row.chars, row.n) == (100_000, 100)
    assert html.extract_products(df).select(F.size("features")).first()[0] == 70
    assert html.extract_products(df, features=50).select(F.size("features")).first()[0] == 50

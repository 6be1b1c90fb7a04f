import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.functions import urls

BASE = "https://Shop.example.com/a/b/c?x=1"
CASES = [
    ("HTTP://Example.com:80/Path/?b=2&a=1#top", "http://example.com/Path?a=1&b=2"),
    ("https://example.com:443", "https://example.com/"),
    ("https://example.com:8443/x//", "https://example.com:8443/x"),
    ("/p/q/", "https://shop.example.com/p/q"),
    ("d.html", "https://shop.example.com/a/b/d.html"),
    ("../d?utm_source=z&k=v", "https://shop.example.com/a/d?k=v"),
    ("./../../../../d", "https://shop.example.com/d"),
    ("//cdn.example.com/z", "https://cdn.example.com/z"),
    ("?q=2", "https://shop.example.com/a/b/c?q=2"),
    ("https://e.com/x?b=&a=1&REF=2&gclid=3", "https://e.com/x?a=1"),
    ("https://e.com/x?k=2&j=0&k=1", "https://e.com/x?j=0&k=2&k=1"),
    ("https://e.com/x?q=a+b%20c&t=~*", "https://e.com/x?q=a+b+c&t=~%2A"),
    ("https://e.com/x;v=1?y=%zz", "https://e.com/x?y=%25zz"),
]


def test_normalize(spark):
    df = spark.createDataFrame([(u, e) for u, e in CASES], "url string, expected string")
    got = df.withColumn("n", urls.normalize_url(F.col("url"), F.lit(BASE))).collect()
    assert [(r.url, r.n) for r in got] == CASES


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abAB/?&=#.%~* ;+é", max_size=25), min_size=1, max_size=20))
def test_normalize_is_idempotent(spark, tails):
    df = spark.createDataFrame([(f"http://Host.example.com/{t}",) for t in tails], "url string")
    once = df.withColumn("once", urls.normalize_url(F.col("url")))
    again = once.withColumn("twice", urls.normalize_url(F.col("once")))
    assert all(r.once == r.twice for r in again.collect())


@pytest.mark.parametrize("url,depth,kind,priority", [
    ("https://e.com", 0, "general", 2), ("https://e.com/", 0, "general", 0), ("https://e.com/home", 1, "general", 0),
    ("https://e.com/Products/x", 2, "product", 1), ("https://e.com/blog/a/b/", 3, "content", 2),
    ("https://e.com/about", 1, "navigation", 3), ("https://e.com/signin", 1, "auth", 4),
    ("https://e.com/l?page=3", 1, "general", 4), ("https://e.com/pricing", 1, "pricing", 1),
    ("https://e.com/faq", 1, "documentation", 3), ("https://e.com/tag/x", 2, "general", 4)])
def test_classes(value, url, depth, kind, priority):
    u = F.col("u")
    row = value(F.struct(urls.url_depth(u), urls.link_type(u), urls.crawl_priority(u, urls.link_type(u))), u=url)
    assert tuple(row) == (depth, kind, priority)


def test_skipped_files(value):
    assert value(urls.skipped_file(F.col("u")), u="https://e.com/a.PDF")
    assert not value(urls.skipped_file(F.col("u")), u="https://e.com/a.html")

"""Sitemap indexes of any depth, rings included, against a plain walk."""

import random

from marketlens.sources import site_files


def index(*names):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in names) + "</sitemapindex>"


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def found(spark, files, **more):
    docs = spark.createDataFrame(files, "url string, body string")
    return sorted((r.root, r.url) for r in site_files.read_sitemaps(docs, **more).collect())


def walk(bodies, root, entries, max_nested=None):
    """Files that a root leads to, level by level, and their urls in reading order."""
    paths, front = {root: ()}, [root]
    while front:
        new = {}
        for doc in front:
            for k, child in enumerate(bodies.get(doc, [])[:max_nested]):
                if child not in paths:
                    way = (*paths[doc], k)
                    new[child] = min(new.get(child, way), way)
        paths.update(new)
        front = list(new)
    return [u for doc in sorted((d for d in paths if d in entries), key=paths.get) for u in entries[doc]]


def test_levels_and_rings(spark):
    files = [("top", index("mid", "leaf1")), ("mid", index("deep", "top2", "gone")), ("deep", index("leaf2", "mid")),
             ("top2", urlset("t2")), ("leaf1", urlset("u1", "u2")), ("leaf2", urlset("u3")),
             ("ring1", index("ring2", "r")), ("ring2", index("ring3")), ("ring3", index("ring1", "r", "under")),
             ("r", urlset("v")), ("under", index("a-leaf")), ("a-leaf", urlset("w")), ("self", index("self", "s")), ("s", urlset("x")),
             ("alone", urlset("y")), (None, urlset("z")), ("bad", "<urlset><url>"), ("none", None)]
    assert found(spark, files) == sorted(
        [("top", u) for u in ("u1", "u2", "u3", "t2")] + [("ring1", "v"), ("ring1", "w"), ("self", "x"), ("alone", "y")])
    roots = spark.createDataFrame([("deep",), ("gone",), (None,), ("deep",)], "url string")
    assert found(spark, files, roots=roots) == [("deep", "t2"), ("deep", "u3")]
    assert found(spark, []) == []


def test_reading_order_and_limits(spark):
    """``max_urls`` keeps the first urls as a reader meets them, ``max_nested`` the first children of each index."""
    files = [("i", index("b", "x", "a")), ("b", index("b2", "b1")), ("x", urlset("x1", "x2")), ("a", urlset("a1")),
             ("b1", urlset("c1")), ("b2", urlset("d1", "d2"))]
    order = ["d1", "d2", "c1", "x1", "x2", "a1"]
    for n in range(1, 7):
        assert found(spark, files, max_urls=n) == sorted(("i", u) for u in order[:n])
    assert found(spark, files, max_nested=1) == [("a", "a1"), ("b1", "c1"), ("i", "d1"), ("i", "d2"), ("x", "x1"), ("x", "x2")]


def test_random_graphs(spark):
    """Any graph of indexes: every root's urls are those of a walk, and every file belongs to some root."""
    rng = random.Random(4)
    for size in (12, 60):
        bodies = {f"n{i}": list(dict.fromkeys(f"n{rng.randrange(size)}" for _ in range(rng.choice([1, 1, 2, 4]))))
                  for i in range(size) if rng.random() < 0.6}
        entries = {f"n{i}": [f"u{i}.{k}" for k in range(2)] for i in range(size) if f"n{i}" not in bodies}
        got = found(spark, [*((n, index(*c)) for n, c in bodies.items()), *((n, urlset(*u)) for n, u in entries.items())])
        roots = {root for root, _ in got}
        assert got == sorted((root, u) for root in roots for u in walk(bodies, root, entries))
        named = {c for n, children in bodies.items() for c in children if c != n}
        assert {n for n in entries if n not in named} <= roots
        assert {u for _, u in got} == {u for urls in entries.values() for u in urls}

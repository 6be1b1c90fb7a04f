"""Robots rule index and suffix rules against plain loops; seen keys over many batches."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from marketlens.operators import frontier
from marketlens.session import scratch_dir
from marketlens.streaming import runs
from marketlens.streaming.seen import SeenTable, dedupe_stored


def allowed(path, rules):
    def hit(kind):
        for k, pattern in rules:
            if k == kind:
                if "*" in pattern or pattern.endswith("$"):
                    body = pattern[:-1] if pattern.endswith("$") else pattern
                    text = "".join(".*" if c == "*" else re.escape(c) for c in body) + (r"\Z" if pattern.endswith("$") else "")
                    if re.match(text, path, re.DOTALL):
                        return True
                elif path.startswith(pattern):
                    return True
        return False

    return hit("allow") or not hit("disallow")


@pytest.mark.parametrize("many", [3, 10_000])
def test_robots_random_rules(spark, monkeypatch, many):
    """Hosts of few and of many rules, blocks of few urls, nested and equal patterns, odd characters."""
    monkeypatch.setattr(frontier, "MANY_RULES", many)
    monkeypatch.setattr(frontier, "BLOCK_URLS", 7)
    rng = random.Random(2)
    letters = "ab/é.*$"
    rules = [(f"h{rng.randrange(6)}.com", rng.choice(["allow", "disallow"]),
              "/" + "".join(rng.choice(letters) for _ in range(rng.randrange(6)))) for _ in range(60)]
    rules += rules[:5] + [("h0.com", "crawl-delay", "2"), ("h1.com", "disallow", "/a"), ("h1.com", "disallow", "/a😀"), ("h1.com", "disallow", "/aé")]
    targets = [(f"http://h{rng.randrange(8)}.com/" + "".join(rng.choice("ab/é.") for _ in range(rng.randrange(8))), i) for i in range(300)]
    targets += [("http://h1.com", 1000), ("http://h1.com/a😀b", 1001), ("", 1002), ("http://H2.com/ab", 1003), ("http://h2.com/ab", 1003)]
    got = frontier.robots_allowed(spark.createDataFrame(targets, "url string, n int"),
                                  spark.createDataFrame(rules, "host string, kind string, pattern string"))
    by = {}
    for host, kind, pattern in rules:
        by.setdefault(host, []).append((kind, pattern))
    want = []
    for url, n in targets:
        host, path = re.match(r"(?:http://([^/]*))?(.*)", url).groups()
        host = (host or "").lower()
        want.append((url, n, host, allowed(path or "/", by.get(host, []))))
    assert sorted(map(tuple, got.select("url", "n", "host", "allowed").collect())) == sorted(want)


def test_robots_host_of_very_many_rules(spark):
    """50 000 rules of one host: a lookup costs by the digits of their number, so ten times the rules cost about the same."""
    def timed(size):
        rules = spark.range(size).selectExpr(
            "'big.com' AS host", "'disallow' AS kind", "concat('/dir', id % 977, '/page', id) AS pattern").unionByName(
            spark.range(3).selectExpr("'big.com' AS host", "'allow' AS kind", "concat('/dir', id, '/page', id, '/open*x') AS pattern"))
        targets = spark.range(0, 100_000, 1, 8).selectExpr(
            "concat('http://big.com/dir', id % 977, '/page', id, if(id % 2 = 0, '/openx', '')) AS url", "id")
        start = time.perf_counter()
        out = frontier.robots_allowed(targets, rules).agg(
            F.count(F.lit(1)), F.count_if("allowed"), F.sum(F.when(F.col("allowed"), F.col("id")))).first()
        return tuple(out), time.perf_counter() - start

    # A target is blocked where its number begins with that of a rule of its folder.
    ruled = {(i % 977, str(i)) for i in range(50_000)}

    def free(i):
        if i < 3 and i % 2 == 0:
            return True
        text = str(i)
        return not any((i % 977, text[:n]) in ruled for n in range(1, len(text) + 1))

    want = [i for i in range(100_000) if free(i)]
    few = timed(5_000)
    got, seconds = timed(50_000)
    assert got == (100_000, len(want), sum(want))
    assert seconds < 4 * few[1] + 10


def test_robots_host_of_very_many_wildcards(spark):
    """Wildcard rules with one beginning: a path meets those that share its end or a piece of it, not all of them."""
    def timed(size):
        rules = spark.range(size).selectExpr("'big.com' AS host", "'disallow' AS kind", """CASE id % 3
            WHEN 0 THEN concat('/q/*/', id, '$') WHEN 1 THEN concat('/q/*/', id, '/*') ELSE concat('/q/*-', id, '-*x$') END AS pattern""")
        targets = spark.range(0, 30_000, 1, 8).selectExpr("id", """concat('http://big.com/q/a', CASE id % 3
            WHEN 0 THEN concat('/', id) WHEN 1 THEN concat('/', id, '/b') ELSE concat('-', id, '-c', if(id % 2 = 0, 'x', 'y')) END) AS url""")
        start = time.perf_counter()
        out = frontier.robots_allowed(targets, rules).agg(F.count_if("allowed"), F.sum(F.when(F.col("allowed"), F.col("id")))).first()
        return tuple(out), time.perf_counter() - start

    few = timed(300)
    got, seconds = timed(15_000)
    want = [i for i in range(30_000) if i >= 15_000 or (i % 3 == 2 and i % 2)]
    assert got == (len(want), sum(want))
    assert seconds < 4 * few[1] + 10


def test_rules_of_suffixes(spark):
    rules = spark.createDataFrame([("com", False), ("*.ck", None), ("!www.ck", False), ("blogspot.com", True), ("UK", False),
                                   ("co.uk", False), (None, False), ("co.uk", False)], "rule string, private boolean")
    hosts = [("a.b.com", "b.com", "b.com"), ("blogspot.com", "blogspot.com", None), ("x.blogspot.com", "blogspot.com", "x.blogspot.com"),
             ("q.www.ck", "www.ck", "www.ck"), ("www.ck", "www.ck", "www.ck"), ("a.ck", None, None), ("b.a.ck", "b.a.ck", "b.a.ck"),
             ("ck", None, None), ("co.uk", None, None), ("x.y.CO.UK:8080", "y.co.uk", "y.co.uk"), ("y.uk.", "y.uk", "y.uk"),
             ("one.two.unknown", "two.unknown", "two.unknown"), ("localhost", None, None), ("192.168.0.1", None, None),
             ("[::1]:80", None, None), ("", None, None), (None, None, None), ("a..com", None, None), ("b.com", "b.com", "b.com"),
             ("b.com", "b.com", "b.com")]
    df = spark.createDataFrame([(h,) for h, _, _ in hosts], "host string")
    for private, at in ((False, 1), (True, 2)):
        got = frontier.registrable_by_rules(df, "host", rules, private).collect()
        assert sorted(((r.host, r.domain) for r in got), key=str) == sorted(((h[0], h[at]) for h in hosts), key=str)
    plain = frontier.registrable_by_rules(df, "host", rules.filter("rule = 'com'").select("rule"), out="d")
    assert {r.d for r in plain.filter("host = 'x.blogspot.com'").collect()} == {"blogspot.com"}


def test_seen_table(spark):
    """Many batches, repeated and empty ones, null keys, compaction; the stream equals a distinct over all."""
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", "b", "c", "d", None]), i) for i in range(60)]
    base, schema = scratch_dir(spark, "t-seen"), "scan_id int, url string, n int"
    for i in range(0, 60, 10):
        spark.createDataFrame(rows[i:i + 10], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = runs.read_stream(spark, f"{base}/in", schema, per_trigger=1)
    seen = SeenTable(spark, f"{base}/seen", stream.select("scan_id", "url").schema, buckets=4)
    dedupe_stored(stream, seen, f"{base}/out", f"{base}/cp", time="n").awaitTermination()
    first = {}
    for scan, url, n in rows:
        first.setdefault((scan, url), n)
    got = spark.read.parquet(f"{base}/out/*")
    assert {((r.scan_id, r.url), r.n) for r in got.collect()} == set(first.items()) and got.count() == len(first)
    assert seen.rows().count() == len(first) == seen.size().agg(F.sum("keys")).first()[0]
    # The third batch again, as after a failure: the same rows come out, and none is added.
    again = spark.createDataFrame(rows[20:30], schema)
    want = {(k, n) for k, n in first.items() if 20 <= n < 30}
    found = seen.first_of(again, ["n"], 2)
    assert {((r.scan_id, r.url), r.n) for r in found.collect()} == want
    seen.add(found, 2)
    assert seen.rows().count() == len(first)
    packed = seen.compact(f"{base}/packed")
    assert sorted(packed.rows().collect(), key=str) == sorted(seen.rows().collect(), key=str)
    assert packed.first_of(spark.createDataFrame(rows, schema), ["n"], 99).count() == 0
    # The table's side of the join is read without an exchange: the batch is dealt out once, by the window over its keys.
    plan = packed.first_of(again, ["n"], 99)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning(_known") == 0

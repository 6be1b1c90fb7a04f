"""Trigram search against a plain contains, rolling trends against the series."""

import datetime as dt
import random

from pyspark.sql import functions as F

from marketlens.operators import compare, search
from marketlens.session import scratch_dir


def test_search_equals_contains(spark):
    rng = random.Random(5)
    letters = "aAbBéÉ .#%_ß😀"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(9))), rng.choice(["abc.com", "", None, "Ab"]))
            for i in range(200)] + [(900, None, None), (901, "aaaaaa", "aaaaaa")]
    df = spark.createDataFrame(rows, "id long, name string, domain string")
    index = search.TrigramIndex(spark, scratch_dir(spark, "t-tri"), df.schema["id"], ["name", "domain"], buckets=4)
    assert index.search(df.limit(0), "abc").count() == 0
    for part in range(3):
        index.add(df.filter(F.col("id") % 3 == part), str(part))
        index.add(df.filter(F.col("id") % 3 == part), str(part))
    for text in ["abc", "AB", "", "a", "aaa", "bé ", "É.#", "%_ß", "abc.com", "😀a", "zzz", "ab.", "  b"]:
        want = sorted(i for i, n, d in rows if any(v is not None and text.lower() in v.lower() for v in (n, d)))
        assert sorted(r.id for r in index.search(df, text).collect()) == want, text
    # Three postings are read for a text of many trigrams, and only rows of these.
    assert len(index.chosen("abc.com")) == 3
    assert index.postings(index.chosen("aaaaaa")).count() <= 4
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        index.postings(["abc"])._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(trigram,abc)" in plan


def test_rolling_trend_equals_series(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(6), i, start + dt.timedelta(hours=rng.randrange(24 * 40)) if rng.random() < 0.95 else None,
             rng.choice([None, 10, 14, 40, 90])) for i in range(400)]
    df = spark.createDataFrame(rows, "competitor_id int, id int, analyzed_at timestamp, overall_score int")
    # Stored in five parts, late ones last.
    daily = None
    for k in range(5):
        part = compare.daily_scores(df.filter(F.col("id") % 5 == k))
        daily = part if daily is None else daily.unionByName(part)
    columns = ["competitor_id", "points", "first_score", "last_score", "change", "trend"]
    for as_of, days in (("2024-02-01 12:00:00", 7), ("2024-02-09 00:00:00", 30), ("2024-01-20 23:59:59", 1), ("2030-01-01", 5)):
        got = compare.rolling_trend(daily, df, as_of, days).select(columns).collect()
        want = compare.score_trend(df, as_of, days).select(columns).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))

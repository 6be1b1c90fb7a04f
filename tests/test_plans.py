"""Skewed keys, positions, plan shapes, sinks and readers."""

import datetime as dt
import json
import random
import re
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions.arrays import let
from marketlens.operators import compare, frontier, gaps, listings
from marketlens.plans import catalog
from marketlens.plans.skew import latest_per_key, with_position, with_previous
from marketlens.session import scratch_dir
from marketlens.sources import sinks, tables

SF = "/root/testdata/sf0.001"


def _captures(spark, zone):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(1 if rng.random() < 0.4 else rng.randint(2, 60), start + dt.timedelta(minutes=rng.randint(0, 3000)), i,
             rng.randint(1, 99)) for i in range(3000)]
    return spark.createDataFrame(rows, "k int, at timestamp, id int, v int").withColumn("at", F.col("at").cast(zone))


def test_previous_row_of_hot_keys(spark):
    for zone in ("timestamp", "timestamp_ntz"):
        df = _captures(spark, zone)
        plain = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("at", "id")))
        split = with_previous(df, ["k"], "at", ["id"], F.col("v"), "p", hot_rows=40)
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, split.select(plain.columns).collect()),
                                                                      key=str)


def test_previous_row_when_a_key_has_one_instant(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), i, i) for i in range(50)], "k int, at timestamp, id int, v int")
    got = with_previous(df, ["k"], "at", ["id"], F.col("v"), "p", hot_rows=5).orderBy("id").collect()
    assert [r.p for r in got] == [None, *range(49)]


def test_previous_row_with_null_times_and_one_huge_key(spark):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    rows = [(str(uuid.UUID(int=1 if rng.random() < 0.9 else rng.randint(2, 30))),
             None if rng.random() < 0.2 else start + dt.timedelta(minutes=rng.randint(0, 3)), i, None if i % 7 == 0 else i)
            for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, at timestamp, id int, v int")
    want = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("at", "id"))).collect()
    for hot in (3, 100, 1900, 10_000):
        got = with_previous(df, ["k"], "at", ["id"], F.col("v"), "p", hot_rows=hot).select("k", "at", "id", "v", "p").collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_positions(spark):
    rng = random.Random(1)
    makers = (lambda i: str(uuid.UUID(int=rng.getrandbits(128))), lambda i: rng.getrandbits(62), lambda i: i)
    for make, kind in zip(makers, ("string", "long", "long")):
        df = spark.createDataFrame([(make(i), float(rng.randint(0, 3)), i % 2) for i in range(500)], f"id {kind}, score double, g int")
        order = [F.col("score").desc(), F.col("id")]
        got = with_position(df, order, "pos").orderBy("pos").collect()
        want = sorted(((r.id, r.score) for r in got), key=lambda r: (-r[1], r[0]))
        assert [r.pos for r in got] == list(range(1, 501)) and [(r.id, r.score) for r in got] == want
        for g in (0, 1):
            rows = with_position(df, order, "pos", ["g"]).filter(F.col("g") == g).orderBy("pos").collect()
            assert [r.pos for r in rows] == list(range(1, 251))
            assert [(r.id, r.score) for r in rows] == [w for w in want if w in {(r.id, r.score) for r in rows}]


def test_ranking_takes_the_ids_of_the_entity_tables(spark):
    names = [k for k, _, _ in compare.METRICS]
    rows = [(str(uuid.uuid4()), f"c{i}", *[float(i % 7)] * len(names)) for i in range(40)]
    df = spark.createDataFrame(rows, "competitor_id string, competitor_name string, " + ", ".join(f"{n} double" for n in names))
    ranked = compare.weighted_ranking(df, rows[3][0])
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 41))


def test_pages_of_a_list_without_a_limit(spark):
    rows = [(i, f"c{i}", "direct", True, True, dt.datetime(2024, 1, 1 + i)) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, name string, competitor_type string, is_active boolean, is_monitoring boolean, created_at timestamp")
    assert [r.id for r in listings.list_competitors(df, skip=3, limit=None).collect()] == [1, 0]
    assert [r.id for r in listings.list_competitors(df, limit=None).collect()] == [4, 3, 2, 1, 0]


def test_frontier_limits_on_request(spark):
    links = spark.createDataFrame([(1, f"u{i:05d}", i % 9, i % 5, i) for i in range(1500)],
                                  "scan_id long, url string, depth int, priority int, added long")
    seen = spark.createDataFrame([(1, "u00000"), (1, "other")], "scan_id long, url string")
    full = frontier.plan_frontier(links, seen).collect()
    assert len(full) == 1499 and sorted(r.position for r in full) == list(range(1, 1500))
    assert [r.url for r in sorted(full, key=lambda r: r.position)] == [
        r.url for r in sorted(full, key=lambda r: (r.priority, r.added))]
    kept = frontier.plan_frontier(links, seen, max_depth=5, max_urls=100).collect()
    assert len(kept) == 98 and max(r.depth for r in kept) == 5


def test_gaps_beyond_the_old_limits(spark):
    """A topic only two others have is found however many topics everybody has."""
    everybody = [f"common{i:03d}" for i in range(150)]
    rows = [(c, json.dumps([t]), "x") for c in (1, 2, 3) for t in everybody for _ in range(2)]
    rows += [(c, json.dumps([f"rare{i:03d}"]), "x") for c in (2, 3) for i in range(60)]
    contents = spark.createDataFrame(rows, "competitor_id long, keywords string, title string")
    sites = spark.createDataFrame([(c,) for c in (1, 2, 3)], "id long")
    found = gaps.content_gaps(contents, sites, 1).collect()
    assert {r.topic for r in found} == {f"Rare{i:03d}" for i in range(60)}
    assert gaps.content_gap_coverage(contents, sites, 1).count() == 120
    assert gaps.content_gaps(contents, sites, 1, n=30).count() == 30


def test_scratch_folder_must_be_shared_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://cluster:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(Session(), "x")
    Context.master = "local[4]"
    assert scratch_dir(Session(), "x")


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_latest_is_pruned_before_the_shuffle(spark):
    df = latest_per_key(spark.read.parquet(f"{SF}/events.parquet"), ["user_id"], "ts", "event_id")
    assert _plan(df).count("WindowGroupLimit") >= 2


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(catalog.QUERIES["price_series"](spark, SF))
    assert "l_quantity" not in plan.split("Physical Plan")[-1]
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan


def test_no_cross_joins(spark):
    streams = {n for n in catalog.ORACLES if n.startswith("stream_") or n in (
        "changes_per_day", "scan_progress", "dedupe_pages", "route_alerts")}
    for name in sorted(set(catalog.ORACLES) - streams):
        plan = _plan(catalog.QUERIES[name](spark, SF)).split("Physical Plan")[-1]
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_let_evaluates_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        calls.add(1)
        return x

    df = spark.range(5).select(counted(F.col("id").cast("int")).alias("u"))
    assert df.select(let(F.col("u"), lambda v: v + v).alias("v")).collect()[4].v == 8
    assert calls.value == 5


def test_append_and_replace(spark):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i % 3)) for i in range(30)], "id int, at timestamp")
    path = scratch_dir(spark, "append")
    sinks.append_snapshot(df, path, "at")
    sinks.append_snapshot(df, path, "at")
    back = spark.read.parquet(path)
    assert back.count() == 60 and back.select("snapshot_date").distinct().count() == 3
    state = scratch_dir(spark, "state")
    sinks.replace_state(df, state)
    assert spark.read.parquet(state).count() == 30


def test_read_table(spark):
    folder = scratch_dir(spark, "tables")
    row = spark.createDataFrame([("1", "c", 5)], "id string, competitor_id string, overall_score int")
    row.write.parquet(f"{folder}/seo_analyses")
    df = tables.read_table(spark, "seo_analyses", folder)
    assert df.first().overall_score == 5 and df.first().title is None
    assert set(tables.SCHEMAS) >= {"competitors", "scans", "scan_pages", "contents", "content_changes", "price_history",
                                   "price_alerts", "products", "product_features", "alerts", "seo_analyses"}


def test_keywords_json(spark):
    df = spark.createDataFrame([(1, '["b","a"]'), (2, '{"x":1,"y":2}'), (3, "nope"), (4, None), (5, "[1,"), (6, "[]")],
                               "id int, kw string")
    got = [(r.id, r.keyword_pos, r.keyword) for r in tables.read_keywords_json(df, "kw").orderBy("id", "keyword_pos").collect()]
    assert got == [(1, 0, "b"), (1, 1, "a"), (2, 0, "x"), (2, 1, "y")]


def test_insights_without_a_site(spark):
    from marketlens.operators import compare as co

    metrics = spark.createDataFrame([], "key string")
    assert co.competitive_insights(metrics, metrics).first().type == "info"


def test_topics_of_a_page_are_read_once_for_coverage(spark):
    rows = [(c, '["Alpha", "beta"]' if c < 3 else '["gamma"]', "All about alpha") for c in range(4)] + [(9, '["beta"]', "x")]
    contents = spark.createDataFrame(rows, "competitor_id long, keywords string, title string")
    sites = contents.select(F.col("competitor_id").alias("id")).distinct()
    covered = gaps.content_gap_coverage(contents, sites, you=9)
    assert "from_json" not in covered._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, covered.collect())) == [("Alpha", 0), ("Alpha", 1), ("Alpha", 2), ("Alpha", 3)]


def test_dealt_rows_are_not_joined_by_bytes(spark):
    keys = spark.range(6000).select((F.col("id") % 900).alias("k")).distinct()
    got = tables.dealt(keys, 6000, "k", most=300).withColumn("part", F.spark_partition_id()).collect()
    assert sorted(r.k for r in got) == list(range(900)) and len({r.part for r in got}) > 15


def test_features_are_folded_in_as_many_tasks_as_their_rows_ask_for(spark, monkeypatch):
    from marketlens.plans import entity_views

    monkeypatch.setitem(tables.dealt.__kwdefaults__, "most", 20)
    folder = scratch_dir(spark, "features")
    lines = [(i % 7, i % 50) for i in range(400)] + [(None, 1), (1, None), (None, None), (3, 999)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, "Brand#1", None if k == 9 else "SMALL" if k % 2 else "LARGE", k % 5) for k in range(50)],
                          "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    features = entity_views.product_features(spark, folder)
    assert re.search(r"hashpartitioning\(l_partkey#\d+L?, 21\), REPARTITION_BY_NUM", _plan(features))  # 404 lines, 20 to a task
    pairs = {(s, p) for s, p in lines if p is not None and p < 50}
    assert sorted((r.competitor_id, r.product_id) for r in features.collect() if r.competitor_id is not None) == sorted(
        (s, f"{s}-{p}") for s, p in pairs if s is not None)
    assert features.filter("competitor_id IS NULL").count() == 1
    sellers = spark.createDataFrame([(s, f"S{s}") for s in range(7)], "id long, name string")
    want = {}
    for s, p in sorted(((s, p) for s, p in pairs if s is not None), key=lambda x: f"{x[0]}-{x[1]}"):
        want[f"Brand#1 {p % 5}", f"S{s}"] = "Present" if p == 9 or p % 2 else "LARGE"
    assert {(r.feature_name, r.competitor_name): r.value for r in gaps.feature_presence(features, sellers).collect()} == want


def test_the_largest_product_without_a_value_wins(spark):
    rows = [("1", 1, "f", "a"), ("2", 1, "f", None), (None, 1, "f", "z"), ("1", 2, "f", "b"), ("1", 2, "f", "c"),
            (None, 3, "f", "d"), (None, 3, "f", None)]
    features = spark.createDataFrame(rows, "product_id string, competitor_id long, feature_name string, feature_value string")
    sellers = spark.createDataFrame([(s, f"S{s}") for s in (1, 2, 3)], "id long, name string")
    cells = gaps._matrix(features, sellers, F.col("feature_value")).collect()
    assert {r.competitor_name: r.value for r in cells} == {"S1": None, "S2": "c", "S3": "d"}

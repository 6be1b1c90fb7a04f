"""Streams against the batch rules: several batches, disorder, late rows, duplicates."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators.prices import detect_price_changes
from marketlens.plans.skew import latest_per_key
from marketlens.session import scratch_dir
from marketlens.streaming import changes as st
from marketlens.streaming import runs
from marketlens.streaming.corrections import CorrectedLag, settle
from marketlens.streaming.previous import late_rows, rows_in_time

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "competitor_id int, product_name string, price decimal(12,2), captured_at timestamp, id int"


def _stream(spark, batches, schema, name):
    """Files written in order, one per micro-batch."""
    folder = scratch_dir(spark, name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return runs.read_stream(spark, folder, schema, per_trigger=1), folder


def _row(day, price, i, product="p"):
    from decimal import Decimal

    return (1, product, Decimal(price), DAY + dt.timedelta(days=day), i)


def test_price_stream_equals_batch_and_marks_late_rows(spark):
    late = _row(1, "77", 9)
    batches = [[_row(2, "101", 2), _row(0, "100", 1), _row(0, "5", 3, "q")], [late, _row(3, "150", 4), _row(3, "150", 5)],
               [_row(4, "5.02", 6, "q"), _row(5, "150.5", 7)]]
    stream, folder = _stream(spark, batches, SCHEMA, "prices")
    every = runs.drain(st.stream_price_changes(stream), "t-prices")
    assert [(r.id, r.status, r.old_price) for r in late_rows(every).collect()] == [(9, "late", None)]
    got = rows_in_time(every)
    batch = detect_price_changes(spark.read.schema(SCHEMA).parquet(folder).filter("id <> 9"))
    columns = ["id", "price", "old_price", "status", "change_percentage"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    assert {r.id: r.status for r in got.collect()} == {
        1: "new", 2: "increase", 3: "new", 4: "increase", 5: "unchanged", 6: "unchanged", 7: "unchanged"}


def test_content_and_product_streams(spark):
    text = "word " * 40
    pages = [[(1, "u", text, DAY), (1, "short", "x", DAY)], [(1, "u", text + "more", DAY + dt.timedelta(1))],
             [(1, "u", "  " + text.upper() + "MORE ", DAY + dt.timedelta(2))]]
    stream, _ = _stream(spark, pages, "competitor_id int, url string, text_content string, checked_at timestamp", "pages")
    got = runs.drain(st.stream_content_changes(stream), "t-pages").orderBy("checked_at").collect()
    assert [r.status for r in got] == ["new", "updated", "unchanged"]
    cards = [[(1, "a", "d", True, DAY)], [(1, "a", "d", False, DAY + dt.timedelta(1))],
             [(1, "a", None, False, DAY + dt.timedelta(2))], [(1, "n", "d", None, DAY)], [(1, "n", "d", None, DAY + dt.timedelta(1))],
             [(1, "n", "d", True, DAY + dt.timedelta(2))]]
    stream, _ = _stream(spark, cards, "competitor_id int, name string, description string, is_available boolean, "
                        "checked_at timestamp", "cards")
    got = runs.drain(st.stream_product_changes(stream), "t-cards").orderBy("name", "checked_at").collect()
    assert [(r.status, r.went_unavailable) for r in got] == [
        ("new", False), ("updated", True), ("updated", False), ("new", False), ("unchanged", False), ("unchanged", False)]


def test_windows_progress_and_duplicates(spark):
    days = [[(i, DAY + dt.timedelta(hours=7 * i)) for i in range(6)], [(9, DAY + dt.timedelta(days=5))],
            [(10, DAY + dt.timedelta(days=5, hours=1))]]
    stream, _ = _stream(spark, days, "id int, detected_at timestamp", "days")
    final = runs.drain(st.changes_per_day(stream, delay="1 day"), "t-days").orderBy("day_start").collect()
    assert [(r.day_start, r.changes) for r in final] == [(DAY, 4), (DAY + dt.timedelta(1), 2)]
    pages = [[(1, "a", DAY), (1, "b", DAY)], [(1, "a", DAY + dt.timedelta(hours=1)), (2, "a", DAY)]]
    schema = "scan_id int, url string, crawled_at timestamp"
    stream, _ = _stream(spark, pages, schema, "scan")
    totals = spark.createDataFrame([(1, 2), (2, 4)], "scan_id int, total int")
    rows = runs.drain(st.scan_progress(stream, totals), "t-progress", mode="update").orderBy("scan_id", "batch").collect()
    assert [(r.scan_id, r.batch, r.pages_crawled, r.progress) for r in rows] == [(1, 0, 2, 100), (1, 1, 3, 100), (2, 1, 1, 25)]
    # Thirty days back and forth: without a delay nothing is left out.
    disorder = [[(i, DAY + dt.timedelta(days=d))] for i, d in enumerate((30, 1, 2, 30))]
    stream, _ = _stream(spark, disorder, "id int, detected_at timestamp", "disorder")
    counts = latest_per_key(runs.drain(st.changes_per_day(stream), "t-all-days", mode="update"), ["day_start"], "batch")
    assert sorted(r.changes for r in counts.collect()) == [1, 1, 2]
    apart = [[(1, f"u{i}", r[0][1])] for i, r in enumerate(disorder)]
    stream, _ = _stream(spark, apart, schema, "apart")
    assert runs.drain(st.dedupe_pages(stream), "t-apart").count() == 4
    stream, _ = _stream(spark, pages, schema, "dedupe")
    assert sorted((r.scan_id, r.url) for r in runs.drain(st.dedupe_pages(stream), "t-dedupe").collect()) == [
        (1, "a"), (1, "b"), (2, "a")]


def test_scans_and_seen_urls_need_no_state_store(spark):
    """Counts and seen urls stand in tables; null keys, a scan without a total, equal rows and repeated batches."""
    schema = "scan_id int, url string, crawled_at timestamp, n int"
    batches = [[(1, "a", DAY, 0), (None, "a", None, 1), (None, None, DAY, 2), (3, "c", DAY, 3)],
               [(1, "b", None, 4), (1, "a", DAY, 5), (None, "a", DAY, 6), (2, None, DAY, 7)],
               [(1, "z", DAY, 4), (None, None, None, 8), (2, "y", None, 9)]]
    totals = spark.createDataFrame([(1, 8), (2, 0), (None, 1)], "scan_id int, total int")
    stream, _ = _stream(spark, batches, schema, "no-state")
    base = scratch_dir(spark, "t-no-state")
    progress = st.scan_progress(stream, totals, tie=("n",))
    progress.start(f"{base}/progress", f"{base}/cp").awaitTermination()
    want = [(1, 0, 1, "a", 12), (1, 1, 3, "a", 37), (1, 2, 4, "a", 50), (2, 1, 1, None, None), (2, 2, 2, None, None)]

    def rows():
        out = progress.written(f"{base}/progress")
        return sorted((r.scan_id, r.batch, r.pages_crawled, r.current_url, r.progress) for r in out.collect())

    # Without a total there is no share, so progress is the bound alone.
    want = [(*w[:4], 100 if w[4] is None else w[4]) for w in want]
    assert rows() == want
    last = spark.createDataFrame(batches[2], schema).select("scan_id", "url", F.struct("crawled_at", "n").alias("_at"))
    again = {r.scan_id: r.pages_crawled for r in progress._folded(last, f"{base}/progress", 2).collect()}
    assert again == {1: 4, 2: 2, 3: 1, None: 4}
    pages = st.dedupe_pages(stream)
    pages.start(f"{base}/pages", f"{base}/cp-pages", buckets=4).awaitTermination()
    got = [(r.scan_id, r.url, r.n) for r in pages.written(f"{base}/pages").collect()]
    assert sorted(got, key=str) == sorted([(1, "a", 0), (None, "a", 1), (None, None, 2), (3, "c", 3), (1, "b", 4),
                                           (2, None, 7), (1, "z", 4), (2, "y", 9)], key=str)
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    states = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(
        spark._jvm.org.apache.hadoop.fs.Path(f"{base}/*/state"))
    assert len(states) == 0


def test_routing(spark):
    events = [[("new_alert", 1), ("scan_progress", 2), ("unknown", 3)], [("competitor_update", 4)]]
    stream, _ = _stream(spark, events, "kind string, n int", "events")
    base = scratch_dir(spark, "routes")
    runs.route_alerts(stream.select("kind", F.struct("n").alias("data")), f"{base}/out", f"{base}/cp").awaitTermination()
    got = {(r.channel, r.message) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {("alerts", '{"type":"new_alert","data":{"n":1}}'), ("scans", '{"type":"scan_progress","data":{"n":2}}'),
                   ("competitors", '{"type":"competitor_update","data":{"n":4}}')}


LAG = "k string, at timestamp, tie int, v string, extra int"


def _lag_rows(rng, size):
    """Rows of few keys over three years, some without key or time, hot days, equal instants and null values."""
    keys, times = ["a", "b", "c", None], [None, *[DAY + dt.timedelta(days=d) for d in (0, 1, 40, 300, 500, 900)]]
    return [(rng.choice(keys + ["a"] * 4), rng.choice(times + times[1:3] * 2), i, rng.choice(["x", "y", "z", None]), i % 3)
            for i in range(size)]


def _lagged(rows):
    order = sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or DAY, r[2]))
    out, last = [], {}
    for r in order:
        out.append((*r, last.get(r[0], (None,))[0], r[0] in last))
        last[r[0]] = (r[3],)
    return sorted(out, key=str)


def test_corrected_lag_in_any_order(spark):
    rng = random.Random(8)
    rows = _lag_rows(rng, 160)
    for order in (sorted(rows, key=lambda r: (r[1] is None, r[1] or DAY), reverse=True), rng.sample(rows, len(rows))):
        parts = [order[i:i + 45] for i in range(0, len(order), 45)]
        stream, _ = _stream(spark, parts, LAG, "corrected")
        lag = CorrectedLag(scratch_dir(spark, "t-corrected"), stream.schema, ["k"], "at", ["tie"], "v", "before")
        lag.start(stream, scratch_dir(spark, "t-cp")).awaitTermination()
        assert sorted((tuple(r) for r in lag.current(spark).collect()), key=str) == _lagged(rows)
    versions = lag.versions(spark)
    # Only rows whose predecessor changed are put out again, each with another predecessor than before.
    assert len(rows) < versions.count() < 2 * len(rows)
    # The last batch once more, as after a failure: nothing changes.
    last = spark.createDataFrame(parts[-1], LAG).coalesce(1)
    before = sorted(versions.collect(), key=str)
    lag.apply(last, len(parts) - 1)
    assert sorted(lag.versions(spark).collect(), key=str) == before


def test_corrected_lag_edges(spark):
    stream, _ = _stream(spark, [[], [("a", None, 1, "x", 0)], [("a", None, 0, "y", 0), ("a", DAY, 5, None, 1)]], LAG, "edges")
    got = settle(stream, "t-edges", lambda path, schema: CorrectedLag(path, schema, ["k"], "at", ["tie"], "v", "before", grain="day"))
    assert sorted((r.tie, r.before, r.known) for r in got.collect()) == [(0, None, False), (1, "y", True), (5, "x", True)]
    stream, _ = _stream(spark, [[]], LAG, "nothing")
    assert settle(stream, "t-nothing", lambda path, schema: CorrectedLag(path, schema, ["k"], "at", ["tie"], "v", "before")).count() == 0
    with pytest.raises(ValueError):
        CorrectedLag("x", stream.schema, ["k"], "at", ["tie"], "v", "EXTRA")


def test_corrected_lag_deals_rows_out_once(spark):
    """A batch keeps only the rows of spans it reached, one first row a span, and links them in a single pass over them."""
    rows = [("a", None, 0, "x", 0), ("a", DAY, 1, "x", 0), ("a", DAY, 2, "y", 0), ("a", DAY + dt.timedelta(400), 3, "x", 0), (None, DAY, 4, "z", 0)]
    folder = scratch_dir(spark, "t-once")
    first, second = spark.createDataFrame(rows, LAG), spark.createDataFrame([("a", DAY, 9, "w", 0)], LAG)
    lag = CorrectedLag(folder, first.schema, ["k"], "at", ["tie"], "v", "before")
    lag.apply(first, 0)
    lag.apply(second, 1)
    links = spark.read.parquet(f"{folder}/links").select("_version", "_first", "row.tie").collect()
    assert sorted((r._version, r._first, r.tie) for r in links) == [
        (0, 0, 2), (0, 1, 0), (0, 1, 1), (0, 1, 3), (0, 1, 4), (1, 0, 9), (1, 1, 1)]
    got = sorted((r.tie, r.before, r.known) for r in lag.current(spark).collect())
    assert got == [(0, None, False), (1, "x", True), (2, "x", True), (3, "w", True), (4, None, False), (9, "y", True)]


def test_state_form_takes_null_times(spark):
    rows = [[(1, "p", None, None, 1), (1, "p", None, None, 2), _row(1, "3", 3)], [(1, "p", None, None, 4), _row(2, "6", 5)]]
    stream, _ = _stream(spark, rows, SCHEMA, "null-times")
    got = runs.drain(st.stream_price_changes(stream), "t-null-times").collect()
    assert sorted((r.id, r.status) for r in got) == [(1, "new"), (2, "new"), (3, "new"), (4, "late"), (5, "increase")]


def test_parts_in_many_files_stay_whole(spark):
    from marketlens.plans import catalog_streams as cs

    folder = scratch_dir(spark, "t-lines")
    lines = [(i, i % 5, 1, i % 3, 6.0, 100.0 + i, 0.0, dt.datetime(1995 + i % 6, 1 + i % 11, 1)) for i in range(120)]
    spark.createDataFrame(lines, cs.LINEITEM.replace("timestamp_ntz", "timestamp")).withColumn(
        "l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).repartition(6).write.parquet(f"{folder}/lineitem.parquet")
    captured = cs._lines(spark, folder).selectExpr(
        "l_suppkey AS competitor_id", "l_partkey AS product_id", "CAST(l_shipdate AS TIMESTAMP) AS captured_at",
        "l_orderkey AS order_key", "CAST(l_extendedprice AS DECIMAL(12,2)) AS price")
    changed = st.stream_price_changes(captured, ("competitor_id", "product_id"), tie=("order_key",))
    base = scratch_dir(spark, "t-parts")
    query = changed.start(base, f"{base}/checkpoint", buckets=4)
    query.awaitTermination()
    # Four parts of time in several files each: as many micro-batches at most, and no row comes late.
    assert max(p["batchId"] for p in query.recentProgress) < 4
    got = changed.written(base).collect()
    assert len(got) == 120 and not any(r.late for r in got)
    assert sum(r.status == "new" for r in got) == 5


def test_change_stream_repeats_a_batch_and_takes_null_keys(spark):
    rows = [[(None, "p", None, DAY, 1), (1, None, None, DAY, 2)],
            [(None, "p", None, DAY + dt.timedelta(1), 3), (1, None, None, DAY - dt.timedelta(1), 4)]]
    stream, _ = _stream(spark, rows, SCHEMA, "null-keys")
    got = runs.drain(st.with_previous_stream(stream, ["competitor_id", "product_name"], "captured_at", ["id"], "id", "before"), "t-null-keys")
    assert sorted((r.id, r.before, r.late) for r in got.collect()) == [
        (1, None, False), (2, None, False), (3, "1", False), (4, None, True)]

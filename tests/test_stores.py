"""Tables that are written step by step: snapshots that count once, state from deltas."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketlens.session import scratch_dir
from marketlens.sources.sinks import SnapshotLog
from marketlens.sources.state_table import StateTable

SCHEMA = "id int, at timestamp, v string"


def rows(spark, ids):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i % 3) if i % 5 else None, f"v{i}") for i in ids], SCHEMA)


def test_snapshots_count_once(spark):
    log = SnapshotLog(spark, scratch_dir(spark, "t-log"), "at")
    assert log.read(SCHEMA).count() == 0
    assert log.append(rows(spark, range(10)), "001")
    assert not log.append(rows(spark, range(10)), "001")
    # Broken off after the rows, before the entry; then after half of the rows, then in full.
    log._put(rows(spark, range(10, 30)), "b-2")
    assert log.read().count() == 10
    log._put(rows(spark, range(10, 14)), "b-2")
    assert log.append(rows(spark, range(10, 20)), "2")
    assert log.append(rows(spark, []), "3")
    want = sorted(range(20))
    assert sorted(r.id for r in log.read().collect()) == want
    assert {(r.id, r.snapshot_date) for r in log.read().collect()} == {
        (i, dt.date(2024, 1, 1 + i % 3) if i % 5 else None) for i in want}
    # Another process sees the same; batches that were compacted still count as written.
    again = SnapshotLog(spark, log.path, "at")
    again.compact("all")
    assert sorted(r.id for r in again.read().collect()) == want and [r.batch for r in again.batches().collect()] == ["b-all"]
    assert not again.append(rows(spark, range(10)), "001")
    assert again.append(rows(spark, [77]), "4") and log.read().count() == 21
    again.compact("all-2")
    assert sorted(r.id for r in log.read().collect()) == [*want, 77]
    with pytest.raises(ValueError):
        log.append(rows(spark, [1]), "../x")


def test_compaction_that_breaks_off(spark):
    log = SnapshotLog(spark, scratch_dir(spark, "t-compact"), "at")
    log.append(rows(spark, [1, 2]), "a")
    log._put(rows(spark, [1, 2]), "b-packed")
    assert log.read().count() == 2
    log.compact("packed")
    assert log.read().count() == 2


def test_state_from_deltas(spark):
    """Random upserts and deletions over several versions, null keys and repeats of a version included."""
    rng = random.Random(3)
    schema = spark.createDataFrame([], "k string, n int, v string").schema
    table = StateTable(spark, scratch_dir(spark, "t-state"), schema, ["k", "n"], buckets=4)
    assert table.current().count() == 0
    model = {}
    for version in range(6):
        keys = list({(rng.choice(["a", "b", "c", None]), rng.choice([1, 2, None])) for _ in range(6)})
        if version == 3:
            df = spark.createDataFrame([(*k, None) for k in keys], schema)
            table.delete(df, version)
            table.delete(df, version)
            for k in keys:
                model.pop(k, None)
        else:
            changed = [(*k, f"{version}") for k in keys]
            table.upsert(spark.createDataFrame(changed, schema), version)
            table.upsert(spark.createDataFrame([(*k, "again") for k in keys], schema), version)
            model.update({k: str(version) for k in keys})
        assert {((r.k, r.n), r.v) for r in table.current().collect()} == set(model.items())
        assert table.current().count() == len(model)
    asked = spark.createDataFrame([("a", 1), ("a", 1), (None, None), ("z", 9), ("c", None)], "k string, n int")
    assert {((r.k, r.n), r.v) for r in table.lookup(asked).collect()} == {
        (k, v) for k, v in model.items() if k in [("a", 1), (None, None), ("c", None)]}
    packed = table.compact(scratch_dir(spark, "t-packed"))
    assert packed.versions().count() == len(model)
    assert sorted(packed.current().collect(), key=str) == sorted(table.current().collect(), key=str)
    # Reading merges inside buckets, looking up deals out the wanted keys only.
    plan = packed.current()._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Exchange" not in plan
    plan = packed.lookup(asked)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Exchange hashpartitioning(_hash" not in plan
    with pytest.raises(ValueError):
        StateTable(spark, "x", spark.createDataFrame([], "k string, _Hash int").schema, ["k"])


def test_upsert_costs_what_changed(spark):
    """A delta of one row writes one row, whatever the table holds."""
    schema = spark.createDataFrame([], "k long, v string").schema
    table = StateTable(spark, scratch_dir(spark, "t-cost"), schema, ["k"], buckets=4)
    table.upsert(spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v")), 0)
    table.upsert(spark.createDataFrame([(5, "y")], schema), 1)
    assert table.versions().count() == 1001 and table.current().count() == 1000
    assert [r.v for r in table.current().filter("k = 5").collect()] == ["y"]

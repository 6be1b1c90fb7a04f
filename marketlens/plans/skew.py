"""Windows that keep working when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import scratch_dir


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  rank: str | None = None) -> DataFrame:
    """First ``n`` rows of every key.

    Spark prunes each input partition to ``n`` rows per key before the exchange
    (WindowGroupLimit), so a hot key sends at most ``n`` rows per map task.
    """
    rn = rank or "_rn"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rn, F.row_number().over(window)).filter(F.col(rn) <= n)
    return out if rank else out.drop(rn)


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, *tie: str) -> DataFrame:
    """Newest row of every key; ``tie`` columns make the choice unique."""
    return top_n_per_key(df, keys, [F.col(c).desc() for c in (ts, *tie)], 1)


def _ranged(df: DataFrame, order: Sequence[Column], purpose: str) -> DataFrame:
    """``df`` dealt out by ranges of ``order`` and written, with each row's range in ``_range``.

    Written, because ranges come from a sample: two reads of the same plan could
    draw them at different places.
    """
    path = scratch_dir(df.sparkSession, purpose)
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def with_previous(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str],
                  value: Column, name: str, hot_rows: int = 2_000_000) -> DataFrame:
    """Add ``value`` of the preceding row of the same key, in (ts, tie) order, null times first.

    A plain ``lag`` sorts each key inside one task. Rows of keys with more than
    ``hot_rows`` rows are instead dealt out by ranges of (key, ts, tie), which
    splits a key even at one instant; inside a range ``lag`` is exact, and the
    first row of a key in a range takes its predecessor from a window over range
    edges, two rows per key and range. The result is the same for any
    ``hot_rows``. There are at most rows / hot_rows such keys, which bounds the
    broadcast; where there are none, nothing is written.
    """
    order = [F.col(ts), *[F.col(c) for c in tie]]
    valued = df.withColumn("_value", F.struct(value.alias("v")))
    # Counted per key hash: one long travels instead of the keys. Keys that share a
    # hash are hot together, which changes no result.
    hashed = df.select(F.xxhash64(*keys).alias("_key"))
    hot = hashed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select("_key")
    plain = Window.partitionBy(*keys).orderBy(*order)
    if hot.isEmpty():
        return valued.withColumn(name, F.lag("_value").over(plain)["v"]).drop("_value")
    keyed = valued.withColumn("_key", F.xxhash64(*keys))
    cold = keyed.join(F.broadcast(hot), "_key", "left_anti").withColumn("_prev", F.lag("_value").over(plain))
    ranged = _ranged(keyed.join(F.broadcast(hot), "_key", "left_semi"), [F.col(k) for k in keys] + order, "previous")
    inside = Window.partitionBy("_range", *keys).orderBy(*order)
    linked = ranged.withColumns({"_prev": F.lag("_value").over(inside), "_next": F.lead("_value").over(inside)})
    edges = (
        linked.filter(F.col("_prev").isNull() | F.col("_next").isNull())
        .withColumn("_first", F.col("_prev").isNull())
        .withColumn("_prev", F.coalesce("_prev", F.lag("_value").over(plain)))
        .filter("_first")
    )
    settled = linked.filter(F.col("_prev").isNotNull()).select(cold.columns).unionByName(edges.select(cold.columns))
    return cold.unionByName(settled).withColumn(name, F.col("_prev.v")).drop("_prev", "_value", "_key")


def with_position(df: DataFrame, order: Sequence[Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Positions 1..n in ``order``, over all rows or for each key of ``by``, no matter how many rows a key has.

    Rows are dealt out by ranges of (key, order) and numbered inside them; a range
    goes on where the rows of its key in earlier ranges end.
    """
    ranged = _ranged(df, [F.col(c) for c in by] + list(order), "position")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each key and range; over all rows, one for each range.
    starts = ranged.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range", *by).orderBy(*order)
    joined = ranged.withColumn("_at", F.row_number().over(inside))
    if by:
        joined = joined.join(starts.select("_start", F.col("_range").alias("_from"), *[
            F.col(c).alias(f"_by_{c}") for c in by]), [F.col("_range") == F.col("_from"), *[
                F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]]).drop("_from", *[f"_by_{c}" for c in by])
    else:
        joined = joined.join(F.broadcast(starts), "_range")
    return joined.withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_at", "_start", "_range")

"""Array helpers that stay inside one row, so they need no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_tokens(tokens: Column) -> Column:
    """Token counts of one array, most frequent first, ties in first-seen order.

    Returns ``array<struct<neg_n, pos, token>>``. Sorting (token, position) pairs
    puts equal tokens side by side; the distance between run starts is the count.
    """

    def runs(pairs: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(pairs) - 1),
            lambda i: (i == 0) | (F.get(pairs, i)["token"] != F.get(pairs, i - 1)["token"]),
        )
        return let(starts, lambda s: F.transform(s, lambda start, k: F.struct(
            (start - F.coalesce(F.get(s, k + 1), F.size(pairs))).alias("neg_n"),
            F.get(pairs, start)["pos"].alias("pos"),
            F.get(pairs, start)["token"].alias("token"),
        )))

    pairs = F.array_sort(F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("pos"))))
    counted = let(pairs, lambda p: F.when(F.size(p) > 0, runs(p)))
    empty = F.expr("cast(array() as array<struct<neg_n:int,pos:int,token:string>>)")
    return F.coalesce(F.array_sort(counted), empty)


def ngrams(tokens: Column, n: int) -> Column:
    """Adjacent n-tuples of an array, joined by one space; empty when too short."""
    return let(tokens, lambda t: F.when(
        F.size(t) >= n,
        F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)),
                    lambda i: F.array_join(F.slice(t, i, n), " ")),
    ).otherwise(F.expr("cast(array() as array<string>)")))


def unnest(df: DataFrame, keep: Sequence[str | Column], array: Column | str, item: str, pos: str = "_pos") -> DataFrame:
    """One row per array element, with the kept columns, ``item`` and its position.

    Plain ``explode`` makes Spark filter out empty arrays beforehand, which works
    out the array once more for each test. The outer form works it out once; rows
    of empty arrays are dropped afterwards.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())
    return rows.drop("_pos")

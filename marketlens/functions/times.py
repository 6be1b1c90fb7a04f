"""Relative time limits that fold to constants, so they reach the file scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def instant(df: DataFrame, col: str, as_of: str) -> Column:
    """``as_of`` in the type of ``col``, with or without a zone."""
    return F.lit(as_of).cast(df.schema[col].dataType)


def before(df: DataFrame, col: str, as_of: str, *, days: int = 0, hours: int = 0) -> Column:
    return instant(df, col, as_of) - F.make_dt_interval(F.lit(days), F.lit(hours))

"""Compare a Spark result with its DuckDB form, value by value."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in data)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    relation = con.sql(sql)
    left_cols, right_cols = spark_df.columns, list(relation.columns)
    if sorted(left_cols) != sorted(right_cols):
        return f"columns differ: spark {sorted(left_cols)} sql {sorted(right_cols)}"
    left = rows(left_cols, [tuple(r) for r in spark_df.collect()])
    right = rows(right_cols, relation.fetchall())
    if left != right:
        extra = [r for r in left if r not in set(right)][:2]
        missing = [r for r in right if r not in set(left)][:2]
        return f"rows spark {len(left)} sql {len(right)}; only spark {extra}; only sql {missing}"
    return None

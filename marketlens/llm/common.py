"""Helpers shared by the operators: written tables, hot-key joins, column names, word caches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import session


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back.

    Cuts the lineage: what follows reads the files and survives a lost executor
    without running ``df`` again.
    """
    path = session.scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a table that is small enough to be broadcast whole.
FEW = 5_000


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, share: int = 200) -> DataFrame:
    """Inner join of ``rows`` with the groups of their key, safe for hot keys.

    ``groups`` has the number of rows of each key in ``size``. Its rows are counted:
    up to ``FEW`` are broadcast. Of more, keys with more than 1/``share`` of all
    rows, at most ``share`` many, are broadcast, and a key left to the sort-merge
    join has at most 1/``share`` of the rows. Both inputs should be written tables,
    as they are read more than once.
    """
    found, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if found <= FEW:
        return rows.join(F.broadcast(groups), key)
    hot = groups.filter(F.col(size) * share > total)
    cold = groups.filter(F.col(size) * share <= total)
    at_once = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return at_once.unionByName(rest)


def row_key(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two hash columns, 96 bits together, that stand for the values of ``columns``; nulls count as values."""
    parts = [c for name in columns for c in (F.col(name).isNull(), F.col(name))]
    high, low = fresh(df, "_row_high", "_row_low")
    return [F.xxhash64(*parts).alias(high), F.hash(*parts).alias(low)]


def whole(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text, F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in runs whose texts have about ``most`` bytes, one row at least.

    A batch has a fixed number of rows, however long they are; what is made of its
    texts is held for one run at a time.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


class ChunkCache:
    """Results by chunk, bounded to twice ``limit`` entries.

    When ``limit`` new entries have come in, the older half goes; a chunk used
    since then is kept. ``make`` gives the results of all unknown chunks of a text
    at once.
    """

    def __init__(self, make: Callable[[list[str]], Iterable], limit: int = 150_000) -> None:
        self.make, self.limit, self.known, self.older = make, limit, {}, {}

    def results(self, chunks: set[str]) -> dict:
        """A dictionary that has all of ``chunks``, valid until the next call."""
        missing = chunks.difference(self.known)
        if not missing:
            return self.known
        if len(self.known) + len(missing) > self.limit:
            self.older, self.known = self.known, {}
            missing = chunks
        again = {c: self.older[c] for c in missing if c in self.older}
        self.known.update(again)
        new = list(missing.difference(again))
        if new:
            self.known.update(zip(new, self.make(new)))
        return self.known

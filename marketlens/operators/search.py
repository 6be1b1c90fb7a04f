"""Contains search by trigrams: candidates from postings, then an exact check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rarest trigrams of a searched text whose postings are read; the check that follows is exact with any number.
MOST = 3


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters in lower case; shorter and null texts have none."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(3))))


class TrigramIndex:
    """Postings (trigram, place, item) of text columns, as parquet laid out by a hash of the trigram and sorted by it.

    A search reads the folders of its trigrams only, and in them, by the statistics of
    sorted files, little else. How often each trigram stands is kept beside, so that
    of a text's trigrams the rarest are read: one that a third of all names hold is
    left out where another will do. New rows come in batches, each in folders of its
    own that a repeated batch replaces; keys may be of any type and should be unique.
    """

    def __init__(self, spark: SparkSession, location: str, key: T.StructField, columns: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.location, self.key, self.columns, self.buckets = spark, location.rstrip("/"), key, list(columns), buckets

    def _bucket(self, trigram: Column) -> Column:
        return F.pmod(F.xxhash64(trigram), F.lit(self.buckets)).cast("int")

    def add(self, rows: DataFrame, batch: str) -> None:
        """Index rows under the name of their batch; a batch whose counts stand is left as it is."""
        if not self._counts().filter(F.col("batch") == f"b-{batch}").isEmpty():
            return
        places = F.array(*[F.struct(F.lit(i).alias("place"), trigrams(F.col(c)).alias("found")) for i, c in enumerate(self.columns)])
        found = rows.select(F.col(self.key.name).alias("item"), F.explode(places).alias("p")).select(
            F.explode("p.found").alias("trigram"), F.col("p.place").alias("place"), "item")
        folder = f"{self.location}/postings/batch=b-{batch}"
        found.withColumn("bucket", self._bucket(F.col("trigram"))).repartition("bucket").sortWithinPartitions(
            "bucket", "trigram").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        # The counts come last: with them the batch counts.
        self.spark.read.schema(self._schema()).parquet(folder).groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).write.mode(
            "overwrite").parquet(f"{self.location}/counts/batch=b-{batch}")

    def _schema(self, *more: T.StructField) -> T.StructType:
        return T.StructType([T.StructField("trigram", T.StringType()), T.StructField("place", T.IntegerType()),
                             T.StructField("item", self.key.dataType), T.StructField("bucket", T.IntegerType()), *more])

    def _counts(self) -> DataFrame:
        # An empty table is a table.
        self.spark.createDataFrame([], "trigram string, n long").write.mode("ignore").parquet(f"{self.location}/counts/batch=none")
        return self.spark.read.schema("trigram string, n long, batch string").parquet(f"{self.location}/counts")

    def chosen(self, text: str, most: int = MOST) -> list[str] | None:
        """The rarest trigrams of a text, [] where one of them stands nowhere, None for texts without trigrams."""
        low = text.lower()
        wanted = {low[i:i + 3] for i in range(len(low) - 2)}
        if not wanted:
            return None
        counts = {r.trigram: r.n for r in self._counts().filter(F.col("trigram").isin(sorted(wanted))).groupBy("trigram").agg(
            F.sum("n").alias("n")).collect()}
        return sorted(wanted, key=lambda t: (counts[t], t))[:most] if len(counts) == len(wanted) else []

    def postings(self, chosen: list[str]) -> DataFrame:
        """Rows of the chosen trigrams; the folders to read are known when the query is planned."""
        rows = self.spark.read.schema(self._schema(T.StructField("batch", T.StringType()))).parquet(f"{self.location}/postings")
        wanted = F.lit(False)
        for t in chosen:
            wanted |= (F.col("bucket") == self._bucket(F.lit(t))) & (F.col("trigram") == t)
        return rows.filter(wanted)

    def candidates(self, text: str, most: int = MOST) -> DataFrame | None:
        """Keys of rows of which one column holds all chosen trigrams; None where the text has none."""
        chosen = self.chosen(text, most)
        if chosen is None:
            return None
        if not chosen:
            return self.spark.createDataFrame([], T.StructType([self.key]))
        met = self.postings(chosen).groupBy("place", "item").agg(F.count_distinct("trigram").alias("n"))
        return met.filter(F.col("n") == len(chosen)).select(F.col("item").alias(self.key.name)).distinct()

    def search(self, rows: DataFrame, text: str) -> DataFrame:
        """Rows of which a column contains the text, in any case; texts of under three characters read all rows."""
        low = F.lit(text.lower())
        hit = F.lit(False)
        for c in self.columns:
            hit |= F.coalesce(F.contains(F.lower(c), low), F.lit(False))
        found = self.candidates(text)
        return rows.filter(hit) if found is None else rows.join(found, self.key.name, "left_semi").filter(hit)

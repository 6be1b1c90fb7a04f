"""Exact deduplication against a persistent digest index.

The index is a bucketed table sorted by digest. New documents are reduced to one
row per digest, anti-joined with the index by sort-merge and appended, so a batch
costs one pass over its texts and one scan of the digests, never of old texts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import session
from marketlens.llm.common import attach, documents, fresh, saved, whole

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """Lower-case A to Z only. Texts of ASCII alone take the faster general form."""
    text = whole(text)
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """Digests seen so far with the document that stays, as parquet bucketed and sorted by digest.

    ``location`` is a folder in a store that all executors share; opening it again,
    in this session or another, finds the same rows. One batch is appended at a
    time. An append is one committed write, and a batch given twice finds its own
    rows, so a repeated run ends in the same decisions.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64) -> None:
        self.spark, self.location, self.buckets = spark, location.rstrip("/"), buckets
        self.table = "digest_index_" + hashlib.md5(self.location.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.location}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame) -> None:
        """Append the digests of ``groups`` that the index lacks.

        The merge hint keeps the join a sort-merge one: the index side is read bucket
        by bucket without an exchange, only the new digests are dealt out.
        """
        known = self.rows().select("digest").hint("merge")
        new = groups.join(known, "digest", "left_anti").select("digest", F.col("max_id").alias("keep_id"))
        # As many partitions as buckets, so each task writes the file of one bucket.
        new.repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def compact(self, location: str) -> DigestIndex:
        """The same index in a new folder, with one sorted file per bucket."""
        out = DigestIndex(self.spark, location, self.buckets)
        self.rows().repartition(self.buckets, "digest").write.insertInto(out.table)
        self.spark.catalog.refreshTable(out.table)
        return out


def decisions(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept.

    Of equal new texts the largest id stays, unless an earlier batch holds the text.
    ``group_size`` counts the batch. Null text is empty text; a null id counts below
    all others, and where only null ids share a text, each of their rows is kept
    false but one is found by ``deduplicate``. Repeated rows with the id that stays
    are all marked kept. Empty tables give no rows.
    """
    rows = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest")),
                 "digests")
    groups = saved(rows.groupBy("digest").agg(
        F.max("doc_id").alias("max_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    index.add(groups)
    settled = saved(groups.join(index.rows().hint("merge"), "digest").select("digest", "keep_id", "group_size"),
                    "digest-settled")
    return attach(rows, settled, "digest", "group_size").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with their own columns only."""
    dig, mark = fresh(docs, "_digest", "_mark")
    stay = decisions(docs, index, id_col, text_col).filter("kept").select(
        F.col("digest").alias(dig), F.col("doc_id").alias(mark)).distinct()
    # Joined on digest and id: a group of many copies is dealt out by its ids.
    tagged = docs.withColumn(dig, digest(F.col(text_col)))
    same = (tagged[dig] == stay[dig]) & tagged[id_col].cast("long").eqNullSafe(stay[mark])
    return tagged.join(stay, same, "left_semi").dropDuplicates([id_col, dig]).select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one batch into a new index."""
    index = DigestIndex(spark, session.scratch_dir(spark, "digest-index"))
    return decisions(documents(spark, sf_dir), index).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

"""Text fingerprints and near-duplicate search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions import text as tx
from marketlens.plans.components import components, written


#: Tokens whose votes are counted at a time, how many a 16-bit counter takes, and tokens of texts taken together.
RUN, MOST_VOTES, TOGETHER = 1 << 17, (1 << 16) - 1, 1 << 19


def votes(tokens: pa.ListArray) -> np.ndarray:
    """64-bit simhash of each list of tokens, as signed numbers.

    Each token adds one to the bits set in the last half of its MD5 and takes one
    from the others; a bit is set in the result where the sum is not negative, so no
    tokens set all. A distinct token of a batch is hashed once; its 64 votes are 16-bit
    counters, four to a machine word, which are added up along the texts.
    """
    words = tokens.flatten().dictionary_encode()
    hashed = b"".join(hashlib.md5(t).digest()[8:] for t in words.dictionary.cast(pa.binary()).to_pylist())
    bits = np.unpackbits(np.frombuffer(hashed, np.uint8)).astype("<u2").reshape(-1, 64).view("<u8")
    which, edges = words.indices.to_numpy(), tokens.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    # Runs end where texts do, where counters are full and where enough tokens are held.
    cuts = np.unique(np.concatenate([edges, np.arange(edges[0], edges[-1], MOST_VOTES)]))
    sums = np.zeros((len(edges) - 1, 64), np.int64)
    a = 0
    while a < len(cuts) - 1:
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + RUN, "right")) - 1)
        counted = np.add.reduceat(bits[which[cuts[a]:cuts[b]]], cuts[a:b] - cuts[a], axis=0).view("<u2")
        np.add.at(sums, np.searchsorted(edges, cuts[a:b], "right") - 1, counted)
        a = b
    kept = 2 * sums >= np.diff(edges)[:, None]
    return np.packbits(kept, axis=1).view(">i8").astype(np.int64).reshape(-1)


def _voted(tokens: pa.ListArray) -> pa.Array:
    """The votes of a batch, so many texts at a time that their words and bits stay few; a longer text is taken alone."""
    edges = tokens.offsets.to_numpy()
    done, parts = 0, []
    while done < len(tokens):
        to = max(done + 1, int(np.searchsorted(edges, edges[done] + TOGETHER, "right")) - 1)
        parts.append(votes(tokens.slice(done, to - done)))
        done = to
    return pa.array(np.concatenate(parts) if parts else [], pa.int64())


@F.arrow_udf(T.LongType())
def _vote(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield _voted(batch)


def _as_hex(bits: str) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def simhash64(df: DataFrame, key: str, text: str) -> DataFrame:
    """64-bit simhash of each text, as hex and as a long. No shuffle."""
    tokens = tx.words(tx.normalize_text(F.coalesce(F.col(text), F.lit(""))))
    return df.select(key, _vote(tokens).alias("simhash_bits")).select(key, _as_hex("simhash_bits").alias("simhash"), "simhash_bits")


def fingerprint(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per text: full_hash, 64-bit simhash (hex and long), phrase_hash, word and character counts. No shuffle."""
    normal = df.select(key, tx.normalize_text(F.coalesce(F.col(text), F.lit(""))).alias("_normal"))
    facts = normal.select(
        key, F.sha2("_normal", 256).alias("full_hash"), tx.phrase_hash(F.col("_normal")).alias("phrase_hash"),
        tx.word_count(F.col("_normal")).alias("word_count"), F.length("_normal").alias("char_count"),
        _vote(tx.words(F.col("_normal"))).alias("simhash_bits"))
    return facts.select(key, "full_hash", "phrase_hash", "word_count", "char_count",
                        _as_hex("simhash_bits").alias("simhash"), "simhash_bits")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(full_a: Column, full_b: Column, bits_a: Column, bits_b: Column) -> Column:
    """1 for equal texts, else the share of equal simhash bits."""
    return F.when(full_a == full_b, 1.0).otherwise(F.lit(1.0) - hamming(bits_a, bits_b) / F.lit(64))


def fingerprint_similarity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Similarity of two fingerprints of the same key, such as two versions of a page."""
    b = right.select(key, F.col("full_hash").alias("_full"), F.col("simhash_bits").alias("_bits"))
    return left.join(b, key).select(key, similarity(
        F.col("full_hash"), F.col("_full"), F.col("simhash_bits"), F.col("_bits")).alias("similarity"))


def copy_groups(fingerprints: DataFrame, key: str) -> DataFrame:
    """Every text with the first key and size of its group of exact copies.

    Counts are folded map-side and joined back, so a group holding a third of all
    rows is one row in the aggregate and is split by AQE in the join.
    """
    groups = fingerprints.groupBy("full_hash").agg(
        F.min(key).alias("first_key"), F.count(F.lit(1)).alias("copies"))
    return fingerprints.select(key, "full_hash").join(groups, "full_hash")


def band_masks(max_distance: int) -> list[int]:
    """Bit masks such that two 64-bit values within the distance agree on at least one of them.

    Split the bits in d + 1 bands: one of them holds no difference. Split the
    other bits in d + 1 parts: again one holds none. Each mask joins such a band
    and part, so keys stay long (28 bits for d = 3) and buckets small.
    """
    def split(bits: list[int], n: int) -> list[list[int]]:
        return [bits[i * len(bits) // n:(i + 1) * len(bits) // n] for i in range(n)]

    masks = []
    n = max_distance + 1
    for band in split(list(range(64)), n):
        rest = [b for b in range(64) if b not in band]
        for part in split(rest, n):
            masks.append(sum(1 << b for b in band + part))
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def near_duplicates(simhashes: DataFrame, key: str, max_distance: int = 3) -> DataFrame:
    """Pairs of distinct simhash values at most ``max_distance`` bits apart, none missed.

    Texts are first collapsed to one row per simhash value (its texts are at
    distance 0 from each other), so copies never meet in the pair join. A pair
    agreeing on several masks is kept at the first one only, which needs no
    de-duplicating shuffle. Only longs travel through the join; AQE splits a
    bucket that is still large.
    """
    # Written once: both sides of the join read the values, not the texts they come from.
    return _value_pairs(written(_values(simhashes, key), "simhash-values"), max_distance)


def _values(simhashes: DataFrame, key: str) -> DataFrame:
    return simhashes.groupBy("simhash_bits").agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("texts"))


def _masks(max_distance: int) -> list[str]:
    return [f"{_signed(m)}L" for m in band_masks(max_distance)]


def _keyed(values: DataFrame, max_distance: int) -> DataFrame:
    """A row for each value and mask: the columns of ``values``, band, band_key."""
    band_keys = ", ".join(f"simhash_bits & {m}" for m in _masks(max_distance))
    return values.select(*values.columns, F.posexplode(F.expr(f"array({band_keys})")).alias("band", "band_key"))


def _first_band(max_distance: int) -> Column:
    """The first mask on which the two values of a pair agree."""
    return F.expr("CASE " + " ".join(
        f"WHEN (simhash_bits_a ^ simhash_bits_b) & {m} = 0 THEN {i}" for i, m in enumerate(_masks(max_distance))) + " END")


def _value_pairs(values: DataFrame, max_distance: int) -> DataFrame:
    keyed = _keyed(values, max_distance)
    a = keyed.select("band", "band_key", *[F.col(c).alias(f"{c}_a") for c in values.columns])
    b = keyed.select("band", "band_key", *[F.col(c).alias(f"{c}_b") for c in values.columns])
    diff = F.col("simhash_bits_a").bitwiseXOR(F.col("simhash_bits_b"))
    # A broadcast would be planned by the size of the values, but hold a row for each value and mask.
    pairs = a.join(b.hint("merge"), ["band", "band_key"]).filter(
        (F.col("simhash_bits_a") < F.col("simhash_bits_b")) & (F.bit_count(diff) <= max_distance)
        & (_first_band(max_distance) == F.col("band")))
    distance = F.bit_count(diff)
    return pairs.select(
        "simhash_bits_a", "simhash_bits_b", "first_key_a", "first_key_b", "texts_a", "texts_b",
        distance.alias("distance"), (F.lit(1.0) - distance / F.lit(64)).alias("similarity"))


def near_duplicate_groups(simhashes: DataFrame, key: str, max_distance: int = 3) -> DataFrame:
    """Every text with its group: ``key``, simhash_bits, group_key (the least key of the group) and group_texts.

    Texts of one simhash value are at distance 0 and in one group; values at most
    ``max_distance`` bits apart are linked, and groups are what links join. One row
    per text, so the output grows with the texts, not with the pairs.
    """
    hashed = written(simhashes.select(key, "simhash_bits"), "simhashes")
    values = written(_values(hashed, key), "simhash-values")
    linked = components(_value_pairs(values, max_distance).select(
        F.col("simhash_bits_a").alias("src"), F.col("simhash_bits_b").alias("dst")))
    rooted = values.join(linked, values["simhash_bits"] == linked["node"], "left").select(
        "simhash_bits", "first_key", "texts", F.coalesce("root", "simhash_bits").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("first_key").alias("group_key"), F.sum("texts").alias("group_texts"))
    return hashed.join(rooted.join(groups, "root").select("simhash_bits", "group_key", "group_texts"), "simhash_bits")


class SimhashIndex:
    """Near duplicates over batches: new texts are hashed and looked up, old ones are not touched.

    Two tables under ``location``: the values of each batch with their least key and
    number of texts, and for every value its masked keys, as parquet bucketed and
    sorted by the hash of (band, key). A batch is dealt out by that hash and joined to
    the index bucket by bucket, without an exchange of the index; links go to a third
    table. Links are found once, in the batch that brings the later of two values. A
    batch that is repeated after a failure finds and adds the same.
    """

    def __init__(self, spark: SparkSession, location: str, max_distance: int = 3, buckets: int = 64) -> None:
        self.spark, self.location, self.max_distance, self.buckets = spark, location.rstrip("/"), max_distance, buckets
        self.table = "simhash_keys_" + hashlib.md5(self.location.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (_hash BIGINT, band INT, band_key BIGINT, simhash_bits BIGINT, _batch BIGINT) "
            f"USING parquet CLUSTERED BY (_hash) SORTED BY (_hash) INTO {buckets} BUCKETS LOCATION '{self.location}/keys'")

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.location}/{name}/batch={batch}")

    def add(self, simhashes: DataFrame, key: str, batch: int) -> None:
        """Take in the texts of one batch (``key``, simhash_bits); batches are numbered in any rising order."""
        self._write(_values(simhashes, key), "values", batch)
        own = self.spark.read.parquet(f"{self.location}/values/batch={batch}").select("simhash_bits")
        known = self.spark.table(self.table).filter(F.col("_batch") < batch)
        keyed = _keyed(own, self.max_distance).withColumn("_hash", F.xxhash64("band", "band_key"))
        old = self.spark.read.parquet(f"{self.location}/values").filter(F.col("batch") < batch).select("simhash_bits")
        fresh = written(keyed.join(old, "simhash_bits", "left_anti").repartition(self.buckets, "_hash"), "simhash-keys")
        new = fresh.select("_hash", F.col("band").alias("_band"), F.col("band_key").alias("_key"), F.col("simhash_bits").alias("_new"))
        found = []
        for side in (known, fresh):
            met = new.join(side.select("_hash", "band", "band_key", "simhash_bits").hint("merge"), "_hash").filter(
                "band = _band AND band_key = _key AND simhash_bits <> _new")
            pair = met.select("band", F.least("simhash_bits", "_new").alias("simhash_bits_a"),
                              F.greatest("simhash_bits", "_new").alias("simhash_bits_b"), "_new")
            found.append(pair if side is known else pair.filter("_new = simhash_bits_a"))
        distance = F.bit_count(F.col("simhash_bits_a").bitwiseXOR(F.col("simhash_bits_b")))
        self._write(found[0].unionByName(found[1]).withColumn("distance", distance).filter(
            (F.col("distance") <= self.max_distance) & (_first_band(self.max_distance) == F.col("band"))).select(
            "simhash_bits_a", "simhash_bits_b", "distance"), "links", batch)
        again = self.spark.table(self.table).filter(F.col("_batch") == batch)
        if again.isEmpty():
            fresh.select("_hash", "band", "band_key", "simhash_bits", F.lit(batch).cast("long").alias("_batch")).repartition(
                self.buckets, "_hash").write.insertInto(self.table)
            self.spark.catalog.refreshTable(self.table)

    def values(self) -> DataFrame:
        """simhash_bits, first_key, texts over all batches."""
        return self.spark.read.parquet(f"{self.location}/values").groupBy("simhash_bits").agg(
            F.min("first_key").alias("first_key"), F.sum("texts").alias("texts"))

    def links(self) -> DataFrame:
        """simhash_bits_a, simhash_bits_b, distance of all pairs of values of all batches, the smaller value first."""
        return self.spark.read.parquet(f"{self.location}/links").drop("batch")

    def pairs(self) -> DataFrame:
        """All links with the first key and the number of texts of both values, as :func:`near_duplicates` gives them."""
        values, out = self.values(), self.links()
        for side in ("a", "b"):
            out = out.join(values.select(*[F.col(c).alias(f"{c}_{side}") for c in values.columns]), f"simhash_bits_{side}")
        return out.withColumn("similarity", F.lit(1.0) - F.col("distance") / F.lit(64))

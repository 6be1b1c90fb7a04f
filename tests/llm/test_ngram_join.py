"""The Jaccard join against a comparison of all pairs."""

import regex

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import ngram_join as nj

SF = "/root/testdata/sf0.001"


def grams(text):
    words = regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())
    if not words:
        return frozenset()
    width = min(5, len(words))
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def brute(rows):
    """doc_id, class_id, n_links of each row by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    label, links = list(range(n)), [0] * n

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and common * 5 >= len(sets[i] | sets[j]) * 4:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], least.get(top(i)), links[i]) for i in range(n)), key=str)


def run(df):
    return sorted((tuple(r) for r in nj.near_copies(df).select("doc_id", "class_id", "n_links").collect()), key=str)


def test_given_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert run(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def family(size, words=100, seed=3):
    """Texts with one or two words changed in a common one, and a few with many."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 10_000, words)]
    out = []
    for i in range(size):
        text = list(base)
        for k in rng.integers(0, words, 1 + i % 5):
            text[k] = f"x{i}y{k}"
        out.append(" ".join(text))
    return out


def test_blocks_of_a_large_family(spark, monkeypatch):
    """Families and buckets larger than a block give the same links."""
    monkeypatch.setattr(nj, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(nj, "FAMILY_BLOCK", 16)
    rows = list(enumerate(family(90) + family(40, 30, 4) + ["alone and not like any other text here"]))
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_edges(spark):
    long = " ".join(f"v{i % 977}q{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n!?"), (4, "one two"), (5, "One, two!"), (6, "one two three"), (None, "one two"),
            (7, long), (8, long + " tail"), (9, long), (9, long), (10, "é è ñ ü ß a"), (11, "É È Ñ Ü ß A")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn(
        "class_id", F.lit(1)).withColumn("Row_High", F.lit(2))
    assert run(df) == brute(rows)
    kept = nj.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "2", "3", "4", "6", "7"]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert run(df) == [] and nj.keep_one(df).count() == 0


def test_bitmap_lets_all_wanted_rows_through(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    found = {r.id for r in nj.maybe_in(rows, rows.filter("id % 100 = 0"), "h").collect()}
    assert found >= set(range(0, 20_000, 100)) and len(found) < 220
    assert nj.maybe_in(rows, rows.limit(0), "h").count() == 0


def test_posterior():
    """The tail of the Beta posterior, against a sum over a fine grid."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    for m, n in ((3, 16), (10, 16), (20, 32), (100, 128)):
        weight = grid ** m * (1 - grid) ** (n - m)
        assert nj.posterior(m, n) == pytest.approx(weight[grid >= 0.8].sum() / weight.sum(), rel=1e-3)
    assert all(nj.posterior(m, n) >= nj.TOLERANCE > nj.posterior(m - 1, n)
               for m, n in zip(nj.least_matches(), range(nj.STEP, nj.HASHES + 1, nj.STEP)))


def test_minhash_is_close_to_the_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    a, b = pool[:3000], pool[600:3600]
    same = np.mean([(nj.minhash(np.unique(a[i:i + 300])) == nj.minhash(np.unique(np.r_[a[i + 60:i + 300], b[i:i + 60]]))).mean()
                    for i in range(0, 2700, 300)])
    assert abs(same - 240 / 360) < 0.06


def test_keep_one_with_clashing_names(spark):
    """Columns that are called as the operator's own are carried through."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 5, 6, "a", 1), (2, text + " x", 7, 8, "b", 2), (3, "other words", 9, 9, "c", 3), (3, "other words", 9, 9, "d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key_high long, KEY_LOW long, key_all string, _number int")
    df = df.selectExpr("*", "1 AS _first_high", "2 AS node", "3 AS class_node", "4 AS row_high", "5 AS _Every")
    kept = nj.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]

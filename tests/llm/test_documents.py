"""Digest index, shards, toxicity, quality rules: contracts on given and awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens import session
from marketlens.llm import common, exact_dedup, quality, sharding, toxicity

SF = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, lang string, source string, digest string, Kept int, _row_high long, score double, key string"


def wide(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2, 0.5, "k") for r in rows], WIDE)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


AWKWARD = [(1, None, "en", None), (2, "", None, "s"), (3, "Kept ONCE", "en", "s"), (4, "kept once", "en", "s"),
           (4, "kept once", "en", "s"), (5, "É KEPT", "fr", "s"), (6, "é kept", "fr", "s"), (7, "É kept", "fr", "s"),
           (None, "alone", "en", "s"), (8, "KK İ", "en", "s"), (9, "word " * 60_000, "en", "s"), (10, "\t\n \r", "en", "s")]


def test_digest_index_batches(spark):
    df = wide(spark, AWKWARD)
    index = exact_dedup.DigestIndex(spark, session.scratch_dir(spark, "index"), 4)
    got = exact_dedup.decisions(df, index).collect()
    by = collections.defaultdict(list)
    for r in AWKWARD:
        by[lowered(r[1])].append(r[0])
    want = collections.Counter()
    for text, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in got) == want
    # A second batch: known texts go, unless they are the very document that stayed.
    again = wide(spark, [(4, "KEPT once", "en", "s"), (99, "kept ONCE", "en", "s"), (100, "new", "en", "s")])
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.decisions(again, index).collect()} == {
        (4, 4, True), (99, 4, False), (100, 100, True)}
    reopened = exact_dedup.DigestIndex(spark, index.location, 4)
    assert reopened.rows().count() == len(by) + 1
    packed = reopened.compact(session.scratch_dir(spark, "index"))
    assert sorted(packed.rows().collect()) == sorted(reopened.rows().collect())
    plan = packed.rows().join(packed.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan


def test_deduplicate_keeps_columns(spark):
    df = wide(spark, AWKWARD)
    kept = exact_dedup.deduplicate(df, exact_dedup.DigestIndex(spark, session.scratch_dir(spark, "index"), 4))
    assert kept.columns == df.columns
    rows = kept.collect()
    assert len(rows) == len({lowered(r[1]) for r in AWKWARD})
    assert {r.doc_id for r in rows} == {2, 4, 6, 7, None, 8, 9, 10}
    empty = df.limit(0)
    assert exact_dedup.deduplicate(empty, exact_dedup.DigestIndex(spark, session.scratch_dir(spark, "index"), 4)).count() == 0


@pytest.mark.parametrize("few", [0, 5000])
def test_attach_hot_and_cold(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    rows = common.saved(spark.range(1000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"), "id"), "rows")
    sums = common.saved(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "sums")
    assert {(r.id, r.n) for r in common.attach(rows, sums, "k", "n").collect()} == {
        (i, 600 if i < 600 else 1) for i in range(1000)}


def plain_jump(key, shards):
    key %= 1 << 64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([0, 1, -1, 2**63 - 1, -2**63, *range(2, 3000, 7)], np.int64)
    for n in (1, 2, 40, 41, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    before, after = sharding.jump(np.arange(20_000), 40), sharding.jump(np.arange(20_000), 41)
    moved = before != after
    assert (after[moved] == 40).all() and abs(moved.mean() - 1 / 41) < 0.005


def test_shards(spark):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), wide(spark, AWKWARD * 3).repartition(4)):
        source = collections.Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()),
                                      plain_jump(r.doc_id or 0, 40), plain_jump(r.doc_id or 0, 41)) for r in df.collect())
        got = sharding.assign(df, 40).collect()
        assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == source
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(wide(spark, []), 40).count() == 0


def test_write_shards(spark):
    path = session.scratch_dir(spark, "shards")
    sharding.write_shards(spark.range(100).withColumnRenamed("id", "doc_id"), path, 7)
    assert {(r.doc_id, r.shard) for r in spark.read.parquet(path).collect()} == {(i, plain_jump(i, 7)) for i in range(100)}


def test_toxicity_held_out():
    """On rows kept out of the fit the model tells the labels apart."""
    spark = session.build()
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 500
    wrong = sum(r.predicted != r.toxic for r in rows)
    # Some labelled texts are junk without any of the words that the label is for.
    assert wrong <= len(rows) * 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_factorization_learns_pairs():
    """Two terms that are harmless alone and toxic together: a sum of weights alone can't fit this as well."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.4
        rows.append(np.array([t for t, on in ((11, a), (22, b), (33, rng.random() < 0.5)) if on], np.int32))
        labels.append(int(a and b))
    labels = np.array(labels)
    model = toxicity.FactorizationMachine().fit(rows, labels)
    slots = model.slots()
    p = {k: model._probability(np.array([slots[t] for t in k], int)) for k in ((), (11,), (22,), (11, 22))}
    assert p[(11, 22)] > 0.9 and max(p[()], p[(11,)], p[(22,)]) < 0.1
    same = toxicity.FactorizationMachine().fit(rows, labels)
    assert (same.weights == model.weights).all() and (same.vectors == model.vectors).all()


def test_factorization_learns_pairs_of_neutral_terms():
    """Terms 11 and 22 are toxic together, each alone as common in clean as in toxic texts, among 60 others a text."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.15
        insult = not (a or b) and rng.random() < 0.15
        rows.append(np.unique(np.array([*rng.integers(100, 1600, 60), *(t for t, on in ((11, a), (22, b), (33, insult)) if on)], np.int32)))
        labels.append(int((a and b) or insult))
    labels = np.array(labels)
    for t in (11, 22):
        assert abs(labels[[t in r for r in rows]].mean() - labels.mean()) < 0.05
    model = toxicity.FactorizationMachine().fit(rows[:2500], labels[:2500])
    slots = model.slots()
    p = np.array([model._probability(np.array([slots[t] for t in r.tolist() if t in slots], int)) for r in rows[2500:]])
    assert (p >= toxicity.THRESHOLD).astype(int).tolist() == labels[2500:].tolist()


def test_factorization_scores_against_all_pairs():
    """The score is the sum over all weights and all pairs of terms, and sums by row and by term are plain sums."""
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 60, rng.integers(0, 25))).astype(np.int32) for _ in range(4000)]
    labels = np.array([int({3, 5} <= set(r.tolist()) or 7 in r) for r in rows])
    model = toxicity.FactorizationMachine().fit(rows, labels)
    assert (model.vectors != 0).any()
    slots = model.slots()
    for r in rows[:100]:
        at = [slots[t] for t in r.tolist() if t in slots]
        value = model.bias + sum(model.weights[i] for i in at) + sum(
            float(model.vectors[i] @ model.vectors[j]) for n, i in enumerate(at) for j in at[:n])
        assert math.isclose(model._probability(np.array(at, int)), 1 / (1 + math.exp(-value)), rel_tol=1e-9)


@pytest.mark.parametrize("run", [3, 40, 1 << 20])
def test_entries_by_row_and_term(monkeypatch, run):
    monkeypatch.setattr(toxicity._Entries, "RUN", run)
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, rng.integers(0, 12))).astype(np.int32) for _ in range(60)]
    slot = np.full(40, -1, np.int32)
    slot[5:30] = np.arange(25)
    entries = toxicity._Entries(rows, slot, 60, 25)
    table = np.array([[t in r for t in range(5, 30)] for r in rows])
    assert (entries.columns(np.arange(25)) == table).all()
    assert np.allclose(entries.per_row(np.arange(25) + 0.5), table @ (np.arange(25) + 0.5))
    assert np.allclose(entries.per_term(np.arange(60) - 9.0), (np.arange(60) - 9.0) @ table)


def test_toxicity_awkward(spark):
    docs = wide(spark, AWKWARD)
    labels = spark.createDataFrame([(3, 1, None), (4, 1, 0), (4, 1, 1), (5, 0, 0), (None, 1, 1), (77, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs.drop("score"), model)
    assert scored.columns == [*docs.drop("score").columns, "score"]
    assert all(0 <= r.score <= 1 for r in scored.collect())
    assert toxicity.keep_clean(docs, model, 1.1).count() == len(AWKWARD)
    with pytest.raises(ValueError):
        toxicity.score(docs.drop("score").withColumn("Score", F.lit(1)), model)
    repeated = docs.unionByName(docs.filter("doc_id = 4")).unionByName(docs.filter("doc_id = 4"))
    again = toxicity.fit(repeated, labels)
    assert (again.weights == model.weights).all() and again.bias == model.bias
    assert toxicity.score(docs.drop("score").limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


def statistics(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {p for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    rows = [*AWKWARD, (11, "a b c a b c a b c", "en", "s"), (12, "x\n\n x\nx\n\x1f y\n ", "en", "s"), (13, "a b c d " * 40, "en", "s"),
            (14, "#tag *b* $5 %& |<>", None, None)]
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), wide(spark, rows)):
        want = collections.Counter((r.doc_id, *statistics(r.text)) for r in df.collect())
        got = quality.judge(df).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_quality_agrees_with_labels(spark):
    """Rows labelled good are kept unless the base rules fail them; most of the others are outliers."""
    sf = "/root/testdata/sf0.01"
    rows = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 200 and all(good) and sum(bad) <= 0.1 * len(bad)


def brute_mcd(x, share, floors, steps):
    """Centre and covariance by concentration steps in numpy, from medians, with exact ranks instead of bins."""
    best = None
    ridge = np.diag(np.square(floors))
    mid = np.median(x, 0)
    mad = 1.4826 * np.median(np.abs(x - mid), 0)
    for scale in (np.diag(mad ** 2) + ridge, ridge):
        centre, cov = mid, scale
        for _ in range(steps):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            inner = x[np.argsort(d)[:math.ceil(len(x) * share)]]
            centre, cov = inner.mean(0), np.cov(inner.T, bias=True) + ridge
        if best is None or np.linalg.det(cov) < np.linalg.det(best[1]):
            best = centre, cov
    return best


def test_estimates_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, [0.1, 0.3, 0.5, 0.6], (2000, 4)) @ np.array([[1, .3, 0, 0], [0, 1, .2, 0], [0, 0, 1, 0], [0, 0, .5, 1]])
    x[:500] += [1.5, 2, 3, 2]
    df = common.saved(spark.createDataFrame([("g", *map(float, r)) for r in x], "key string, " + ", ".join(
        f"{n} double" for n in quality.NAMES)), "points")
    found = quality.estimates(df).collect()[0]
    centre, cov = brute_mcd(x, 0.5, list(quality.PARTS.values()), 6)
    low = np.array([[found[f"l_{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    assert np.allclose([found[f"m_{i}"] for i in range(4)], centre, atol=0.03)
    assert np.allclose(low @ low.T, cov, atol=0.03)


def test_floors_are_minima(spark):
    """A part with a spread of its own keeps it; one without gets its floor."""
    spread = [0.5, 0.0, 0.3, 0.0]
    sums = {"key": "g", "n": 100, **{f"s_{i}": 0.0 for i in range(4)},
            **{f"s_{i}{j}": 100 * spread[i] ** 2 if i == j else 0.0 for i in range(4) for j in range(i + 1)}}
    found = quality._with_factor(spark.createDataFrame([sums]), ["key"]).first()
    floors = list(quality.PARTS.values())
    assert [found[f"l_{i}{i}"] for i in range(4)] == pytest.approx([0.5, floors[1], 0.3, floors[3]])


def test_duplicates_and_repeats_can_reject(spark):
    """A text that passes the base rules is an outlier by its duplicate lines and repeated words alone."""
    rows = [(i, " ".join(f"w{j}" for j in range(i % 7, 90)), "en", "s") for i in range(300)]
    lines = "\n".join(["w0 w1 w2"] * 12 + [f"w{3 * i} w{3 * i + 1} w{3 * i + 2}" for i in range(1, 17)])
    got = {r.doc_id: r for r in quality.judge(wide(spark, [*rows, (901, lines, "en", "s")])).collect()}
    assert not got[901].base_failed and not got[901].kept
    assert all(got[i].kept for i in range(300))


def test_chi_square_quantile():
    assert quality.chi_square_quantile(0.5, 4) == pytest.approx(3.356694, abs=1e-5)
    assert quality.chi_square_quantile(0.99, 4) == pytest.approx(13.2767, abs=1e-4)


def test_keep_good(spark):
    df = wide(spark, AWKWARD + [(20, " ".join(f"w{i}" for i in range(80)), None, None)] * 2)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [20, 20]
    assert quality.keep_good(df.limit(0)).count() == 0

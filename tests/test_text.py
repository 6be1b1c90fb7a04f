import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketlens.functions import text as tx
from marketlens.operators import fingerprints as fp

TEXTS = ["", "one", "two words", "The cat sat. The cat ran! Did the cat, the black cat, sleep?",
         "Étude à Paris déjà-vu naïve café", "a b a b a b c", "x\tY\nz  w", "!!! ...", "make size one e ee"]


def _simhash(text):
    normal = re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", text.lower())).strip()
    votes = [0] * 64
    for token in normal.split():
        h = int(hashlib.md5(token.encode()).hexdigest(), 16)
        for bit in range(64):
            votes[bit] += 1 if h >> bit & 1 else -1
    return f"{sum(1 << b for b in range(64) if votes[b] >= 0):016x}"


def test_fingerprint_matches_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    rows = {r.id: r for r in fp.fingerprint(df, "id", "text").collect()}
    for i, text in enumerate(TEXTS):
        normal = re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", text.lower())).strip()
        assert rows[i].simhash == _simhash(text)
        assert rows[i].full_hash == hashlib.sha256(normal.encode()).hexdigest()
        assert (rows[i].word_count, rows[i].char_count) == (len(normal.split()), len(normal))
    assert rows[0].simhash == "f" * 16


def test_counts_keep_first_seen_order(value):
    counted = value(tx.top(tx.words(F.col("t")), 10), t="b a c a b d")
    assert [(r.token, -r.neg_n) for r in counted] == [("b", 2), ("a", 2), ("c", 1), ("d", 1)]
    assert value(tx.top(tx.words(F.col("t")), 10), t="") == []


def test_keywords(value):
    assert value(tx.top_keywords(F.col("t")), t="The price of étage stage-price 12abc price2 STAGE ab") == ["price", "stage"]


def test_short_texts_have_word_phrases(value):
    assert value(tx.top_phrases(F.col("t")), t="just two") == ["just", "two"]
    assert value(tx.top_phrases(F.col("t")), t="a b c a b c") == ["a b c", "b c a", "c a b"]


@pytest.mark.parametrize("word,n", [("make", 1), ("the", 1), ("cafe", 1), ("aeon", 1), ("banana", 3), ("rhythm", 1),
                                    ("xyz", 1), ("bcd", 1), ("create", 1)])
def test_syllables(value, word, n):
    assert value(tx.syllables(F.col("w")), w=word) == n


def test_readability_bounds(value):
    assert value(tx.readability(F.col("t")), t="") == 0.0
    assert value(tx.readability(F.col("t")), t="...") == 0.0
    assert value(tx.readability(F.lit(None).cast("string"))) == 0.0
    assert 0.0 <= value(tx.readability(F.col("t")), t="Go on. Do it. We can.") <= 100.0


@pytest.mark.parametrize("url,title,kind", [
    ("https://e.com/blog/x", "", "blog"), ("https://e.com/a/b/plans", "", "pricing"), ("https://e.com/", "", "landing"),
    ("https://e.com/a", "", "landing"), ("https://e.com/a/b/c", "Latest News", "blog"),
    ("https://e.com/a/b/c", "Our Price list", "pricing"), ("https://e.com/a/b/c", "x", "other"),
    ("https://e.com/en/contact/x", "", "contact"), ("https://e.com/en/team/x", "", "about")])
def test_category(value, url, title, kind):
    assert value(tx.content_category(F.col("u"), F.col("t")), u=url, t=title) == kind


def test_content_hash(value):
    assert value(tx.content_hash(F.col("t")), t="  Some \n TEXT ") == hashlib.sha256(b"some text").hexdigest()


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_band_masks_never_miss(distance):
    import itertools
    import random

    rng, masks = random.Random(distance), fp.band_masks(distance)
    assert len(masks) == (distance + 1) ** 2
    for _ in range(300):
        flips = rng.sample(range(64), distance)
        diff = sum(1 << b for b in flips)
        assert any(diff & m == 0 for m in masks)
    assert all(any(sum(1 << b for b in c) & m == 0 for m in masks)
               for c in itertools.combinations(range(0, 64, 8), min(distance, 2)))


def test_near_duplicates_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = base + [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(6)]
    # One value holds a third of all rows.
    values += [base[0]] * (len(values) // 2)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, simhash_bits long")
    got = {(r.simhash_bits_a, r.simhash_bits_b): (r.distance, r.texts_a, r.texts_b)
           for r in fp.near_duplicates(df, "id", 3).collect()}
    n = Counter(signed)
    distinct = sorted(n)
    want = {}
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            d = bin((a ^ b) & (2 ** 64 - 1)).count("1")
            if d <= 3:
                want[(a, b)] = (d, n[a], n[b])
    assert got == want and want


def test_votes_of_long_and_empty_texts(monkeypatch):
    """Full counters, runs that end inside texts, empty lists and sliced arrays give the plain sums."""
    import random

    import pyarrow as pa

    rng = random.Random(3)
    texts = [[f"w{rng.randrange(50)}é" for _ in range(n)] for n in (0, 3, 70, 0, 1, 25, 0)]
    want = [_simhash(" ".join(t)) for t in texts]
    for run, most in ((1 << 17, (1 << 16) - 1), (5, 4), (30, 7), (1, 1)):
        monkeypatch.setattr(fp, "RUN", run)
        monkeypatch.setattr(fp, "MOST_VOTES", most)
        for cut in (0, 2):
            got = fp.votes(pa.array(texts, pa.list_(pa.string()))[cut:])
            assert [f"{v & (1 << 64) - 1:016x}" for v in got.tolist()] == want[cut:]
    monkeypatch.undo()
    long = ["same"] * 70_000 + ["other"] * 69_000
    assert f"{fp.votes(pa.array([long], pa.list_(pa.string()))).tolist()[0] & (1 << 64) - 1:016x}" == _simhash(" ".join(long))
    assert fp.votes(pa.array([], pa.list_(pa.string()))).tolist() == []


def test_simhash_index_batches(spark):
    """Batches in any cut give the links of one run; a repeated batch adds nothing."""
    import random

    from marketlens.session import scratch_dir

    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = base + [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(8)]
    rows = list(enumerate(v - (1 << 64) if v >> 63 else v for v in values + [base[0]] * 40))
    rng.shuffle(rows)
    columns = ["simhash_bits_a", "simhash_bits_b", "first_key_a", "first_key_b", "texts_a", "texts_b", "distance", "similarity"]
    want = sorted(map(tuple, fp.near_duplicates(spark.createDataFrame(rows, "id long, simhash_bits long"), "id").select(columns).collect()))
    index = fp.SimhashIndex(spark, scratch_dir(spark, "t-simhash"), buckets=4)
    parts = [rows[:30], rows[30:31], [], rows[31:]]
    for batch, part in enumerate(parts):
        index.add(spark.createDataFrame(part, "id long, simhash_bits long"), "id", batch)
    assert sorted(map(tuple, index.pairs().select(columns).collect())) == want
    index.add(spark.createDataFrame(parts[-1], "id long, simhash_bits long"), "id", 3)
    assert sorted(map(tuple, index.pairs().select(columns).collect())) == want
    assert spark.table(index.table).count() == 16 * len({v for _, v in rows})


def test_readability_is_that_of_its_words(spark):
    """Syllables counted over the text are the sum over its words, which the plan no longer visits one by one."""
    rng = random.Random(5)
    bits = ["the", "e", "ae", "tree", "Xyz", "brr", "É", "a.b", "!", "?", " ", "\n", "\u00a0", "\x1c", "be", "queue", "İe", "MADE", "1.5e", "e.e", "_"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(20))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    spoken = F.aggregate(tx.words(F.col("t")), F.lit(0), lambda n, w: n + tx.syllables(w))
    sentences = F.size(F.filter(F.split("t", "[.!?]+"), lambda s: s.rlike(tx.WORD)))
    count = F.size(tx.words(F.col("t")))
    want = F.coalesce(F.when(F.try_divide(count, sentences).isNotNull() & (count > 0), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(206.835) - F.lit(
        1.015) * F.try_divide(count, sentences) - F.lit(84.6) * F.try_divide(spoken, count)))), F.lit(0.0))
    got = df.select(tx.readability(F.col("t")).alias("got"), want.alias("want"))
    assert got.filter("NOT got <=> want").count() == 0
    plan = df.select(tx.readability(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan


def test_near_duplicate_join_is_not_broadcast(spark):
    """Few values are many rows once keyed by all masks: both sides are dealt out and sorted."""
    values = spark.range(50).selectExpr("id AS simhash_bits", "id AS first_key", "1L AS texts")
    plan = fp._value_pairs(values, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_votes_are_counted_for_few_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    rng = random.Random(6)
    tokens = pa.array([[rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(40))] for _ in range(60)], pa.list_(pa.string()))
    whole, sizes = fp.votes(tokens), []
    monkeypatch.setattr(fp, "TOGETHER", 50)
    monkeypatch.setattr(fp, "votes", lambda part, f=fp.votes: sizes.append(len(part.flatten())) or f(part))
    for a in (0, 7):
        assert fp._voted(tokens.slice(a)).to_pylist() == whole[a:].tolist()
    assert max(sizes) <= 50 and sum(sizes) == len(tokens.flatten()) + len(tokens.slice(7).flatten())
    assert fp._voted(tokens.slice(0, 0)).to_pylist() == []

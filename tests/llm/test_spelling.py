"""Spelling variants against a comparison of all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import spelling as sp

KIND = "doc_id long, text string"


def near(a, b):
    """Whether two words differ by exactly one letter put in, left out or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, drop=sp.DROP):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    close = {w: [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)] for w in words}
    form = {}
    for w, found in close.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(close[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def run(df, **more):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n)
                  for r in sp.variants(df, **more).collect())


def corpus(size, seed=1):
    """Texts of a few words with misspellings of misspellings."""
    rng = np.random.default_rng(seed)
    stems = ["banner", "bannner", "aabbcc", "élève", "façades", "straße", "Müller", "letters", "lettres", "abcdefgh"]
    letters = "abcenrsétzÿ"

    def edit(w):
        i, c = rng.integers(0, len(w)), letters[rng.integers(0, len(letters))]
        return [w[:i] + w[i + 1:], w[:i] + c + w[i + 1:], w[:i] + c + w[i:]][rng.integers(0, 3)]

    rows = []
    for doc in range(size):
        words = []
        for _ in range(rng.integers(5, 60)):
            w = stems[min(int(rng.geometric(0.3)), len(stems)) - 1]
            while rng.random() < 0.3:
                w = edit(w)
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((doc, " -1".join(words)))
    return rows


@pytest.mark.parametrize("drop", [3, sp.DROP])
def test_all_pairs(spark, drop):
    rows = corpus(400)
    got = run(spark.createDataFrame(rows, KIND), drop=drop)
    assert got == brute(rows, drop) and sum(r[1] != "" for r in got) > 20


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert run(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_small_filters(spark, monkeypatch):
    """Filters far too small let false words through, which the join removes; small runs change nothing."""
    monkeypatch.setattr(sp, "MOST_BITS", 256)
    monkeypatch.setattr(sp, "AT_ONCE", 300)
    monkeypatch.setattr(sp, "HELD", 10)
    monkeypatch.setattr(sp, "TASK", 7)
    rows = corpus(150, 4)
    words = spark.createDataFrame(brute(rows), "word string, form string, root string, n long, n_near long, form_n long").select("word", "n")
    passed = sp.candidates(words, sp.bloom_filters(words), 3)
    assert passed.join(words.withColumnRenamed("word", "other"), "other", "left_anti").count() > 100
    assert run(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_filters_hold_all_words(spark):
    """No edit that is a word is kept back, and few others pass."""
    rng = np.random.default_rng(3)
    words = sorted({"".join(chr(sp.LETTERS[k]) for k in rng.integers(0, 90, n)) for n in rng.integers(6, 80, 3000)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    filters = sp.bloom_filters(df)
    for length, part, letters in sp._by_length(words):
        assert len(sp._passed(sp.hashes(letters), filters[min(length, sp.LONG)])) == len(part)
    assert sum(len(b) for b in filters.values()) * 64 <= sp.MOST_BITS
    edits = sum(len(w) * 50 for w in words)
    assert sp.candidates(df, filters, 2).count() < edits * 0.01


def test_chains(spark):
    """Forms of forms are followed to the end, however long the chain."""
    names = [f"w{i}" for i in range(29)]
    links = spark.createDataFrame(list(zip(names, names[1:])) + [("alone", "end")], "word string, form string")
    got = {r.word: r.root for r in sp.last_forms(links).collect()}
    assert got == {**{n: "w28" for n in names[:-1]}, "alone": "end"}


def test_edges(spark):
    """Nulls, empty texts, very long words, ties, repeated rows, other characters and clashing names."""
    long, longer = "ab" * 3000, "ab" * 3000 + "c"
    rows = [(1, None), (2, ""), (None, "vowels vowels vowels vowels vowels"), (3, " \x00 éœ×÷-"), (4, "Kelvins " * 5)]
    rows += [(5, f"{long} {long} {long}"), (5, f"{long} {long} {long}")] + [(6, " ".join([longer] * 40))]
    rows += [(i, "abcdef abcdeg " * 3 + "abcdeh " * 30 + "bbcdeh " * 30 + "abcdéf×abcdéf " * 3) for i in range(7, 10)]
    df = spark.createDataFrame(rows, KIND).select("*", F.lit("x").alias("word"), F.lit(1).alias("N"), F.lit(2).alias("root"))
    got = run(df)
    assert got == brute(rows)
    assert any(r[0] == long and r[1] == longer for r in got)


def test_empty(spark):
    assert run(spark.createDataFrame([], KIND)) == []

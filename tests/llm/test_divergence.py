"""Source divergences against plain sums over all kept terms."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from marketlens.llm import divergence as dv

KIND = "text string, lang string, source string, doc_id long"


def brute(rows, least_docs=3, most_terms=200):
    """Every term of every pair, with Python integers."""
    texts, seen, counts = defaultdict(list), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source, *_ in rows:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)
        seen[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
    out = []
    for lang, docs in seen.items():
        kept = [t for t, d in docs.items() if d >= least_docs]
        own = {s: c for (l, s), c in counts.items() if l == lang}

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in own.items()}
        q = shares(sum(own.values(), Counter()))
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)
                        if part == "pair" or most_terms is None or i < most_terms]
    return sorted(out)


def run(df, **more):
    return sorted(tuple(r) for r in dv.audit(df, **more).collect())


def corpus(size, seed=5):
    rng = np.random.default_rng(seed)
    words = [f"W{chr(97 + k % 26)}{'éß'[k % 2]}{chr(97 + k // 26)}" for k in range(120)]
    out = []
    for i in range(size):
        picks = np.minimum(rng.geometric(0.05, rng.integers(0, 60)), 119)
        out.append((" ,".join(words[k] for k in picks), ["en", "de"][i % 3 == 0], f"s{min(i % 11, 6)}", i))
    return out


def test_pairs_and_terms(spark):
    rows = corpus(400)
    assert run(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_blocks(spark, monkeypatch):
    """Many term blocks, peer blocks and products in steps give the same sums."""
    for name, size in (("BLOCK", 40), ("PEERS", 2), ("AT_ONCE", 7), ("HELD", 20)):
        monkeypatch.setattr(dv, name, size)
    rows = corpus(300, 6)
    assert run(spark.createDataFrame(rows, KIND), most_terms=None) == brute(rows, most_terms=None)


def test_scatter():
    """The accumulator equals the products of all pairs of postings."""
    rng = np.random.default_rng(2)
    term = np.sort(rng.integers(0, 30, 100))
    group = np.concatenate([rng.permutation(9)[:n] for n in np.unique(term, return_counts=True)[1]]) if (
        np.unique(term, return_counts=True)[1] <= 9).all() else rng.integers(0, 9, 100)
    p, base = rng.integers(1, 10**9, 100), rng.integers(1, 10**6, 9)
    want = np.zeros((9, 9), object)
    for i in range(100):
        for j in range(100):
            if term[i] == term[j] and group[i] != group[j]:
                g, h, x, q = group[i], group[j], int(p[i]), int(p[j])
                z, b = int(base[h]), int(base[g])
                want[g, h] += (x - q) ** 2 // q - (x - z) ** 2 // z - (b - q) ** 2 // q + (b - z) ** 2 // z
    got = dict(dv.scatter(term, group, p, base))
    assert all(got[g].tolist() == [want[g, h] if h != g else 0 for h in range(9)] for g in range(9))


def test_edges(spark):
    """Nulls, empty and very long texts, groups without terms, ties and repeated rows."""
    long = " ".join(f"term{chr(97 + i % 26)}" for i in range(60_000)) + " " + "x" * 200_000
    rows = [(None, "en", "a", 1), ("", None, "a", 2), ("Same same", None, None, 3), ("Same same", None, None, 3),
            ("same", None, "b", None), (long, "en", "b", 4), (long, "en", "b", 4), (long, "en", "c", 5),
            ("one two", "fr", "a", 6), ("one two", "fr", "b", 7), ("İ K ÀB àb \x00 \x85z", "en", "c", 8), ("àb z", "en", "", 9),
            ("ÀB z", "en", None, 9)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS term", "2 AS n", "3 AS value", "'x' AS Part", "0 AS rank")
    got = run(df)
    assert got == brute(rows)
    assert ("fr", "a", "pair", "b", 0, 1) in got


def test_empty(spark):
    assert run(spark.createDataFrame([], KIND)) == []


@pytest.mark.parametrize("total", [3, 7_919, 10**9 + 7, 9 * 10**14])
def test_exact_shares(spark, total):
    """Shares are exact in columns and in numpy, beyond 64-bit products."""
    counts = np.array([0, 1, total // 3, total - 1], np.int64)
    want = [1 + 10**9 * (int(c) + 1) // total for c in counts]
    assert dv._shares(counts, total).tolist() == want
    df = spark.createDataFrame([(int(c), total) for c in counts], "c long, t long")
    assert [r[0] for r in df.select(dv.share(df.c, df.t)).collect()] == want

"""Embedding links against a comparison of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import embedding_links as el

KIND = "vec_id long, embedding array<float>, label int"


def usable(vector, label):
    return (label is not None and bool(vector) and all(x is not None and math.isfinite(x) for x in vector)
            and any(x != 0 for x in vector))


def brute(rows):
    """vec_id, n_links, component_id, kept by comparing all pairs."""
    n = len(rows)
    label, count = list(range(n)), [0] * n

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    fine = [usable(v, l) for _, v, l in rows]
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    count[i] += 1
                    count[j] += 1
                    a, b = top(i), top(j)
                    label[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    return sorted(((r[0], count[i], least.get(top(i)), r[0] is not None and r[0] == least.get(top(i)))
                   for i, r in enumerate(rows)), key=str)


def run(df):
    return sorted((tuple(r) for r in el.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def clusters(sizes, dim, seed=1, low=0.05, high=0.25):
    """Vectors around centres, at angles on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    out = []
    for k, size in enumerate(sizes):
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            noise = rng.standard_normal(dim)
            vector = centre + noise / np.linalg.norm(noise) * rng.uniform(low, high)
            out.append(((vector * rng.uniform(0.1, 50)).tolist(), k % 3))
    order = rng.permutation(len(out))
    return [(int(i), *out[i]) for i in order]


@pytest.mark.parametrize("dim", [2, 8, 64, 300])
def test_clusters(spark, dim):
    rows = clusters([60, 40, 20] + [2] * 40 + [1] * 60, dim)
    assert run(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert run(df) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_blocks(spark, monkeypatch):
    """Groups larger than a block give the same links."""
    monkeypatch.setattr(el, "FILTER_BLOCK", 16)
    monkeypatch.setattr(el, "FAMILY_NUMBERS", 16 * 32)
    rows = clusters([150, 60, 10], 32, 5, 0.02, 0.2)
    assert run(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_recall_at_the_threshold():
    """Pairs whose cosine is just 0.98, the hardest ones, meet at a filter, for few and for many vectors."""
    rng = np.random.default_rng(7)
    x, z = rng.standard_normal((2, 4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98 ** 2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for rows in (5_000, 500_000, 50_000_000):
        shared = np.zeros(len(x), int)
        for number in range(el.CODES):
            args = (number, *el.shape(rows, 64), el.CAP // el.CODES)
            for a, b in ((i, slice(i, i + 1000)) for i in range(0, len(x), 1000)):
                left, right = el.decode(x[b], *args), el.decode(y[b], *args)
                shared[b] += (left[:, :, None] == right[:, None, :]).sum((1, 2))
        assert (shared > 0).mean() > 0.999 and shared.mean() > 10


def test_decoding_finds_the_best():
    """The listed directions are the closest of all of a code."""
    rng = np.random.default_rng(4)
    units = el.units_of(rng.standard_normal((40, 18)))
    turn, code = el._code(0, 18, 3, 9)
    turned = (units.astype(np.float32) @ turn).reshape(40, 3, 6)
    near = [turned[:, b] @ code[b].T for b in range(3)]
    every = (near[0][:, :, None, None] + near[1][:, None, :, None] + near[2][:, None, None, :]).reshape(40, -1)
    got = el.decode(units, 0, 3, 9, 10)
    least = np.sort(every, 1)[:, -10:].sum(1)
    assert np.allclose(np.take_along_axis(every, got, 1).sum(1), least, atol=1e-4)


def test_sketch_error():
    """The dot product of two sketches is off by no more than their errors say."""
    units = el.units_of(np.random.default_rng(3).standard_normal((300, 64)))
    data = el.sketch(units)
    scale, error = (np.ascontiguousarray(data[:, a:a + 4]).view(np.float32) for a in (0, 4))
    rough = data[:, 8:].view(np.int8) * scale
    assert (np.abs(rough @ rough.T - units @ units.T) <= error + error.T + error * error.T + el.ROUNDING).all()


def test_edges(spark):
    """Nulls, empty, zero and non-finite vectors, other lengths, scales, ties, repeats and clashing names."""
    one, inf, nan = [1.0, 2.0, 3.0], float("inf"), float("nan")
    rows = [(1, one, 1), (2, [2.0, 4.0, 6.0], 1), (2, [2.0, 4.0, 6.0], 1), (3, one, 2), (4, one, None), (5, None, 1),
            (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [inf, 1.0, 1.0], 1), (10, [nan, 1.0, 1.0], 1),
            (11, [1.0, 2.0, 3.0, 0.0], 1), (None, one, 1), (None, [5.0, -1.0, 0.0], 1), (None, None, None),
            (12, [1e38, 2e38, 3e38], 1), (13, [1e-30, 2e-30, 3e-30], 1), (14, [-1.0, -2.0, -3.0], 1), (15, [7.0], 3),
            (16, [1.0], 3), (17, [-1.0], 3), (18, [-0.0, 1.0], 4), (19, [0.0, 1.0], 4)]
    df = spark.createDataFrame(rows, KIND).select("*", F.lit(1).alias("node"), F.lit(2).alias("Copies"), F.lit("x").alias("root"))
    assert run(df) == brute(rows)


def test_cosine_at_the_threshold():
    """Cosines within rounding of 0.98 are settled by exact sums."""
    a, b = np.array([50.0, 0.0]), np.array([49.0, math.sqrt(50 ** 2 - 49 ** 2)])
    vectors = np.stack([a, b * 3, b / 7])
    linked = el.links(vectors, el.units_of(vectors), slice(0, 1), slice(1, 3), np.zeros(3, int))
    assert linked.tolist() == [[el.cosine(a, b * 3) >= 0.98, el.cosine(a, b / 7) >= 0.98]]


def test_empty(spark):
    assert run(spark.createDataFrame([], KIND)) == []

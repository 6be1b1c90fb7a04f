"""Near-duplicate embeddings by spherical-cap filters.

Filter directions form structured random product codes: a rotation, and for each
block of dimensions a list of random unit codewords; a direction is one codeword per
block. Every vector is list-decoded to all directions inside a cap around it that
holds ``CAP`` of them, so no vector has too few. Vectors that meet at a filter are
compared by short sketches with a known error; what may be linked forms families, in
which every pair is verified in double precision.

No step emits all pairs of a group: filter tasks give a spanning forest of the pairs
that may be linked, family tasks give link counts and a spanning forest of the links.
Large groups are cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import attach, documents, saved
from marketlens.llm.ngram_join import _block_tasks, _forest, _sides
from marketlens.plans.components import components

THRESHOLD = 0.98
#: Directions in the cap of a vector, over all codes, and the number of codes.
CAP, CODES = 32, 2
#: Directions of a code for each vector, and most codewords of a block before a third block is taken.
DENSITY, MOST_WORDS = 32, 4096
#: Shorter vectors are filled up with zeros, which leaves cosines as they are: directions need room.
LEAST_DIM = 16
#: Most rows of a filter block, and most numbers of a family block.
FILTER_BLOCK, FAMILY_NUMBERS = 2048, 1 << 18
#: Room for rounding in single precision, and around the threshold in double precision.
ROUNDING, CLOSE = 1e-4, 1e-12
SEED = 12


def shape(rows: int, dim: int) -> tuple[int, int]:
    """Blocks of a code and codewords of each, for so many vectors of ``dim`` numbers.

    The directions grow with the vectors, so that as many unrelated ones meet at any
    size. In few dimensions they stay fewer, as caps would be narrower than a link.
    """
    wanted = min(DENSITY * max(rows, 1), 2 ** min(max(dim, LEAST_DIM) + 4, 62))
    blocks = next((m for m in (2, 3) if wanted ** (1 / m) <= MOST_WORDS), 4)
    return blocks, max(2, math.ceil(wanted ** (1 / blocks)))


@lru_cache(maxsize=16)
def _code(number: int, dim: int, blocks: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotation of ``dim`` numbers, a multiple of ``blocks``, and the codewords of each block."""
    rng = np.random.default_rng([SEED, number, dim, words])
    turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    code = rng.standard_normal((blocks, words, dim // blocks))
    code /= np.linalg.norm(code, axis=2, keepdims=True)
    return turn.astype(np.float32), code.astype(np.float32)


@lru_cache(maxsize=16)
def _ranks(blocks: int, most: int, cap: int) -> np.ndarray:
    """Ranks in each block that one of the ``cap`` best directions can have.

    A direction of ranks (i, j, ...) stands behind all (i + 1)(j + 1)... of lower ranks.
    """
    return np.array([t for t in itertools.product(range(most), repeat=blocks)
                     if math.prod(i + 1 for i in t) <= cap]).T


def decode(units: np.ndarray, number: int, blocks: int, words: int, cap: int) -> np.ndarray:
    """The ``cap`` directions of a code that each unit vector is closest to, by number."""
    dim = max(units.shape[1], LEAST_DIM)
    units = np.pad(units, ((0, 0), (0, dim + -dim % blocks - units.shape[1])))
    turn, code = _code(number, units.shape[1], blocks, words)
    turned = (units.astype(np.float32) @ turn).reshape(len(units), blocks, -1)
    most = min(cap, words)
    ranks = _ranks(blocks, most, cap)
    sums = np.zeros((len(units), ranks.shape[1]), np.float32)
    names = np.zeros((len(units), ranks.shape[1]), np.int64)
    for b in range(blocks):
        near = turned[:, b] @ code[b].T
        best = np.argpartition(-near, most - 1, axis=1)[:, :most]
        value = np.take_along_axis(near, best, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        sums += np.take_along_axis(value, order, 1)[:, ranks[b]]
        names = names * words + np.take_along_axis(best, order, 1)[:, ranks[b]]
    cap = min(cap, sums.shape[1])
    return np.take_along_axis(names, np.argpartition(-sums, cap - 1, axis=1)[:, :cap], 1)


def units_of(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; any scale is taken."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sketch(units: np.ndarray) -> np.ndarray:
    """Rows of bytes: scale and error as 32-bit floats, then a signed byte for each number."""
    scale = (np.abs(units).max(1, keepdims=True) / 127).astype(np.float32)
    small = np.rint(units / scale).clip(-127, 127).astype(np.int8)
    error = np.linalg.norm(units - small * scale.astype(np.float64), axis=1, keepdims=True).astype(np.float32)
    return np.concatenate([scale.view(np.uint8), error.view(np.uint8), small.view(np.uint8)], 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _marks(nodes: DataFrame, rows: int) -> DataFrame:
    """node, dim, bucket: a row for each filter of each vector; a bucket is a direction within a label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                places = np.flatnonzero(dims == dim)
                blocks, words = shape(rows, dim)
                for top in range(0, len(places), max(1, 2_000_000 // max(dim, words))):
                    part = places[top:top + max(1, 2_000_000 // max(dim, words))]
                    units = units_of(_matrix(batch.column(3).take(pa.array(part))))
                    tag = _mix(batch.column(1).to_numpy()[part].view(np.uint64))[:, None]
                    found = []
                    for number in range(CODES):
                        names = decode(units, number, blocks, words, CAP // CODES)
                        found.append(_mix(names.view(np.uint64) * np.uint64(CODES) + np.uint64(number) ^ tag))
                    buckets = np.concatenate(found, 1)
                    node = np.repeat(batch.column(0).to_numpy()[part], buckets.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node), pa.array(np.full(len(node), dim, np.int32)), pa.array(buckets.ravel().view(np.int64))],
                        ["node", "dim", "bucket"])

    return nodes.select("node", "tag", "dim", "vector").mapInArrow(run, "node long, dim int, bucket long")


def _sketches(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = pa.array(np.flatnonzero(dims == dim))
                data = sketch(units_of(_matrix(batch.column(2).take(part))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(part), pa.array([row.tobytes() for row in data], pa.binary())], ["node", "sketch"])

    return nodes.select("node", "dim", "vector").mapInArrow(run, "node long, sketch binary")


def _tiles(rows: slice) -> Iterator[slice]:
    return (slice(top, min(top + 512, rows.stop)) for top in range(rows.start, rows.stop, 512))


def _spanning(nodes: np.ndarray, tiles: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Forest of all edges; of each tile's edges only a forest is held, so that a dense group needs no list of its pairs."""
    rows = np.arange(len(nodes))
    held = [_forest(rows, a, b) for a, b in tiles]
    return _forest(nodes, np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))


def _meeting_task(columns: list[pa.Array]) -> dict:
    """Forest of the pairs of the task's blocks that may be linked, by their sketches."""
    left, right, same = _sides(columns)
    nodes = columns[3].to_numpy()
    data = np.frombuffer(b"".join(columns[4].to_pylist()), np.uint8).reshape(len(nodes), -1)
    scale, error = (np.ascontiguousarray(data[:, a:a + 4]).view(np.float32) for a in (0, 4))
    rough = data[:, 8:].view(np.int8) * scale
    def tiles() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in _tiles(left):
            slack = error[part] + error[right].T + error[part] * error[right].T + ROUNDING
            i, j = np.nonzero(rough[part] @ rough[right].T >= THRESHOLD - slack)
            yield i + part.start, j + right.start

    src, dst = _spanning(nodes, tiles())
    return {"src": src, "dst": dst}


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine of two vectors with sums that are rounded once."""
    x, y = (v.astype(np.float64) / np.abs(v).max() for v in (x, y))
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def links(vectors: np.ndarray, units: np.ndarray, left: slice, right: slice, tags: np.ndarray) -> np.ndarray:
    """Which left and right rows are linked; cosines at the threshold are worked out again with exact sums."""
    cosines = units[left] @ units[right].T
    linked = cosines >= THRESHOLD
    for i, j in zip(*np.nonzero(np.abs(cosines - THRESHOLD) < CLOSE)):
        linked[i, j] = cosine(vectors[left.start + i], vectors[right.start + j]) >= THRESHOLD
    return linked & (tags[left][:, None] == tags[right][None, :])


def _verify_task(columns: list[pa.Array]) -> dict:
    """Links of all pairs of the task's blocks, counted by rows, and their forest."""
    left, right, same = _sides(columns)
    nodes, copies, tags = (columns[c].to_numpy() for c in (3, 4, 5))
    vectors = _matrix(columns[6])
    units = units_of(vectors)
    count = np.zeros(len(nodes), np.int64)

    def tiles() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in _tiles(left):
            linked = links(vectors, units, part, right, tags)
            if same:
                linked[np.arange(part.stop - part.start), np.arange(part.start, part.stop)] = False
            count[part] += linked @ copies[right]
            if not same:
                count[right] += linked.T @ copies[part]
            i, j = np.nonzero(linked)
            yield i + part.start, j + right.start

    src, dst = _spanning(nodes, tiles())
    return {"src": np.concatenate([nodes, src]), "dst": np.concatenate([nodes, dst]),
            "links": np.concatenate([count, np.zeros(len(src), np.int64)])}


def _usable(label: Column, vector: Column) -> Column:
    number = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & number & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Two rows are linked where their labels are equal and their cosine in double
    precision is at least 0.98; ``n_links`` counts the other rows a row is linked with.
    A component is named by its least vec_id, and ``kept`` says that this is the row's.
    Rows whose label or vector is null, or whose vector is empty, zero or holds null or
    non-finite numbers, link with nothing and are components of their own. Vectors of
    different lengths are never linked. Equal vectors, repeated rows included, are
    linked with each other. A null vec_id is a row like others; a component of only
    null ids has a null component_id and kept is false. Empty tables give no rows;
    other columns are not read. Equal vectors are named by 64 bits.
    """
    kind = vectors.schema[vector_col].dataType
    wide = F.col(vector_col) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else F.col(
        vector_col).cast("array<double>")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), wide.alias("vector"))
    usable = _usable(F.col("label"), F.col("vector"))
    rows = base.select("vec_id", F.when(usable, F.xxhash64("label", F.lit(0), "vector")).alias("node"),
                       F.xxhash64("label").alias("tag"), "vector")
    nodes = saved(rows.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.first("tag").alias("tag"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"),
        F.min("vec_id").alias("least")).withColumn("dim", F.size("vector")), "vectors")

    marks = saved(_marks(nodes, nodes.count()), "marks")
    sizes = marks.groupBy("bucket", "dim").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    meeting = saved(marks.join(sizes, ["bucket", "dim"]), "meeting")
    with_sketches = meeting.join(saved(_sketches(nodes), "sketches").hint("merge"), "node")
    maybe = _block_tasks(with_sketches, ["bucket", "dim"], ["sketch"], "size", FILTER_BLOCK, _meeting_task, "src long, dst long")
    families = saved(components(maybe), "families")

    family_size = families.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = families.join(family_size, "root").join(nodes.hint("merge"), "node").withColumn(
        "numbers", F.col("size") * F.col("dim"))
    verified = saved(_block_tasks(members, ["root"], ["copies", "tag", "vector"], "numbers", FAMILY_NUMBERS, _verify_task,
                                  "src long, dst long, links long"), "verified")
    counted = verified.groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.select("node", "copies", "least").join(counted, "node", "left").join(
        components(verified), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    settled = saved(named.join(least, "root").select(
        "node", "copies", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "settled")
    narrow = saved(rows.select("vec_id", "node"), "vector-rows")
    joined = attach(narrow.filter(F.col("node").isNotNull()), settled, "node", "copies").select(
        "vec_id", "n_links", "component_id")
    alone = narrow.filter(F.col("node").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op12_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings within their labels."""
    return near_vectors(documents(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links,
  least(vec_id, coalesce((SELECT min(y) FROM reach WHERE x = vec_id), vec_id)) AS component_id,
  vec_id <= coalesce((SELECT min(y) FROM reach WHERE x = vec_id), vec_id) AS kept
FROM embeddings
"""

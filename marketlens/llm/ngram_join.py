"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts become sets of five-word shingles. Equal sets are folded to one node first.
Nodes that share a band of MinHash values are candidates; their values are compared
a few at a time, and a pair is dropped as soon as the posterior probability that its
similarity reaches the threshold is below a tolerance. What remains is gathered into
families, in which every pair is verified exactly on the shingle sets.

No step emits all pairs of a group: bucket tasks give a spanning forest of the pairs
that remain, family tasks give link counts and a spanning forest of the links. Large
buckets and families are cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import attach, documents, fresh, row_key, saved, whole
from marketlens.plans.components import components

WORDS, THRESHOLD = 5, 0.8
#: 128 MinHash values in 32 bands of 4. A pair at the threshold shares no band with
#: probability (1 - 0.8^4)^32 = 5e-8, a closer one with less.
HASHES, BAND = 128, 4
#: Values compared at a time, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-9
#: Most nodes of a bucket block, and of a family block.
BUCKET_BLOCK, FAMILY_BLOCK = 2048, 256
SEED = 11


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case runs of letters, marks and digits."""
    words = F.array_remove(F.split(F.lower(whole(text)), r"[^\p{L}\p{M}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the five-word windows; fewer words make one shingle, no words none."""
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(WORDS, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - width + 1 + i] + np.uint64(1))
    return np.unique(out)


def node_of(grams: np.ndarray) -> int:
    """64-bit name of a shingle set; equal sets have equal names."""
    data = grams + np.uint64(0x632BE59BD9B4E019) * (np.arange(len(grams), dtype=np.uint64) + np.uint64(len(grams)))
    return int(_mix(_mix(data).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


@lru_cache(maxsize=1)
def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = rng.integers(0, 1 << 32, (2, HASHES), dtype=np.uint64).astype(np.uint32)
    return draw[0][:, None] | np.uint32(1), draw[1][:, None]


def minhash(grams: np.ndarray) -> np.ndarray:
    """The low 16 bits of 128 MinHash values, little end first."""
    odd, shift = _hash_family()
    small = (_mix(grams) >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(small), 1024):
        # Values depend on all bits of the product: the high half is folded onto the low one.
        values = (small[None, at:at + 1024] ^ shift) * odd
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        np.minimum(best, values.min(axis=1), out=best)
    best ^= best >> np.uint32(16)
    return best.astype("<u2")


def posterior(matches: int, compared: int, threshold: float = THRESHOLD) -> float:
    """P(similarity >= threshold | matches of compared values) under a uniform prior.

    The posterior is Beta(matches + 1, compared - matches + 1); its tail is a
    binomial sum.
    """
    n = compared + 1
    return math.fsum(math.comb(n, k) * threshold ** k * (1 - threshold) ** (n - k) for k in range(matches + 1))


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each number of compared values, a multiple of ``STEP``, the fewest matches that keep a pair."""
    return tuple(next(m for m in range(n + 1) if posterior(m, n, threshold) >= tolerance)
                 for n in range(STEP, HASHES + 1, STEP))


def unpruned(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature blocks that survive every comparison step."""
    least = least_matches()
    a_all, b_all = [], []
    for top in range(0, len(left), 128):
        part = left[top:top + 128]
        matches = np.zeros((len(part), len(right)), np.uint8)
        for k in range(STEP):
            matches += part[:, k, None] == right[None, :, k]
        a, b = np.nonzero(matches >= least[0])
        count = matches[a, b].astype(np.int64)
        a += top
        if same:
            up = a < b
            a, b, count = a[up], b[up], count[up]
        for s in range(1, HASHES // STEP):
            if not len(a):
                break
            cols = slice(s * STEP, (s + 1) * STEP)
            count += (left[a, cols] == right[b, cols]).sum(1)
            stay = count >= least[s]
            a, b, count = a[stay], b[stay], count[stay]
        a_all.append(a)
        b_all.append(b)
    return np.concatenate(a_all), np.concatenate(b_all)


def roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component under the edges (a, b)."""
    label = np.arange(size)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    return label


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.Array]]:
    """The columns of each run of rows with equal first ``keys`` columns, runs that cross batches included."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]]
        edge = np.zeros(batch.num_rows, bool)
        for c in cols:
            edge[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns
            held = []
        cuts = [0, *np.flatnonzero(edge).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns


def _binary_rows(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def sketches(texts: DataFrame) -> DataFrame:
    """node, grams, signature for each row of ``texts`` (columns ``words`` and those to keep)."""
    keep = [c for c in texts.columns if c != "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(batch.schema.names.index("words"))
            values = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
            at = words.offsets.to_numpy()
            nodes, grams, signs = [], [], []
            for a, b in zip(at[:-1], at[1:]):
                g = shingles(values[a:b])
                nodes.append(node_of(g))
                grams.append(len(g))
                signs.append(minhash(g).tobytes() if len(g) else None)
            kept = [batch.column(batch.schema.names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(nodes, pa.int64()), pa.array(grams, pa.int64()), pa.array(signs, pa.binary())],
                [*keep, "node", "grams", "signature"])

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.mapInArrow(run, f"{kinds}, node long, grams long, signature binary")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node and its sorted shingle hashes, packed, for each row of ``texts`` (column ``words``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            values = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
            at = words.offsets.to_numpy()
            sets = [shingles(values[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(g) for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())],
                ["node", "shingles"])

    return texts.select("words").mapInArrow(run, "node long, shingles binary")


def _paired(blocks: Column) -> Column:
    """For a row of block ``b`` of ``blocks``: its block pairs as (i, j, side), each pair meeting its two blocks."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(
        F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j"), (F.col("b") > o).alias("right")))


def _block_tasks(rows: DataFrame, keys: list[str], payload: list[str], size: str, most: int,
                 work: Callable[[list[pa.Array]], dict], schema: str) -> DataFrame:
    """Run ``work`` on every pair of blocks of every group of ``rows``.

    A group of ``size`` rows has ceil(size / most) blocks, filled by a hash of the
    node. A row goes to as many tasks as its group has blocks.
    """
    blocks = F.ceil(F.col(size) / most).cast("int")
    tasks = rows.withColumn("k", blocks).withColumn(
        "b", F.pmod(F.xxhash64("node", F.lit("block")), F.col("k")).cast("int")).withColumn("p", F.explode(_paired(F.col("k"))))
    dealt = tasks.select(*keys, "p.i", "p.j", "p.right", "node", *payload).repartition(*keys, "i", "j").sortWithinPartitions(
        *keys, "i", "j", "right", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held = 0
        for columns in groups(batches, len(keys) + 2):
            found = work(columns[len(keys):])
            held += len(next(iter(found.values())))
            out.append(found)
            if held > 20_000:
                yield _joined(out)
                out, held = [], 0
        if out:
            yield _joined(out)

    return dealt.mapInArrow(run, schema)


def _joined(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in found[0]})


def _sides(columns: list[pa.Array]) -> tuple[slice, slice, bool]:
    """Rows of the left and right block, and whether the task holds one block with itself."""
    i, j = columns[0][0].as_py(), columns[1][0].as_py()
    n = len(columns[0])
    if i == j:
        return slice(0, n), slice(0, n), True
    cut = n - int(np.count_nonzero(columns[2].to_numpy(zero_copy_only=False)))
    return slice(0, cut), slice(cut, n), False


def _forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edge from each linked node to the first node of its component."""
    top = roots(len(nodes), a, b)
    off = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[off], nodes[top[off]]


def _prune_task(columns: list[pa.Array]) -> dict:
    left, right, same = _sides(columns)
    nodes = columns[3].to_numpy()
    signs = _binary_rows(columns[4], "<u2").reshape(len(nodes), HASHES)
    a, b = unpruned(signs[left], signs[right], same)
    src, dst = _forest(nodes, a + left.start, b + right.start)
    return {"src": src, "dst": dst}


def common_counts(sets: list[np.ndarray], left: slice, right: slice) -> np.ndarray:
    """Shared shingles of every left and right set, by products of presence matrices of shared shingles."""
    lens = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), lens)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = np.flatnonzero(seen > 1)
    place = np.full(len(seen), -1)
    place[useful] = np.arange(len(useful))
    column = place[column]
    rows, column = rows[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((left.stop - left.start, right.stop - right.start), np.float32)
    for at in range(0, len(useful), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        present = np.zeros((len(sets), min(4096, len(useful) - at)), np.float32)
        present[rows[a:b], column[a:b] - at] = 1
        total += present[left] @ present[right].T
    return total


def _verify_task(columns: list[pa.Array]) -> dict:
    """Exact similarity of all pairs of the task's blocks: links counted by rows, and their forest."""
    left, right, same = _sides(columns)
    nodes, copies = columns[3].to_numpy(), columns[4].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in columns[5].to_pylist()]
    lens = np.array([len(s) for s in sets], np.float64)
    shared = common_counts(sets, left, right).astype(np.float64)
    union = lens[left][:, None] + lens[right][None, :] - shared
    # In whole numbers, so that a similarity of exactly 4/5 counts.
    linked = shared * 5 >= union * 4
    if same:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(nodes), np.int64)
    links[left] += linked @ copies[right]
    if not same:
        links[right] += linked.T @ copies[left]
    a, b = np.nonzero(linked)
    first = _forest(nodes, a + left.start, b + right.start)
    own = np.arange(len(nodes))
    return {"src": np.concatenate([nodes[own], first[0]]), "dst": np.concatenate([nodes[own], first[1]]),
            "links": np.concatenate([links, np.zeros(len(first[0]), np.int64)])}


def maybe_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose 64-bit hash ``key`` is not in ``wanted``.

    A bitmap of 2^26 bits, at most 2048 rows of 4 KB whatever the corpus, is
    broadcast. It lets through all rows that are wanted and some others; a corpus
    that fills it only loses the saving.
    """
    spot = F.pmod(F.col(key), F.lit(1 << 26))
    bitmap = wanted.select((spot + 1).alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    at = F.bitmap_bit_position(spot + 1)
    byte = F.conv(F.hex(F.expr("substring(bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("long")
    joined = rows.withColumn("_at", at).join(F.broadcast(bitmap), F.bitmap_bucket_number(spot + 1) == F.col("part"))
    return joined.filter(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1).select(*rows.columns)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links and classes of all rows: doc_id, row_high, row_low, node, class_node, class_id, n_links.

    Two rows are linked where the Jaccard similarity of their five-word shingle sets
    (lower-case runs of letters and digits; a text of 1 to 4 words is one shingle) is
    at least 0.8. ``n_links`` counts the other rows that a row is linked with, copies
    included. A class is a connected component of links, named by its least doc_id.
    Texts without words, null or not, are linked with nothing; each such row stands
    alone, with its own doc_id as class and class_node null. Repeated rows are copies
    of each other. A null doc_id is a row like others; a class of only null ids has a
    null class_id. Empty tables give no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    high, low = (c.alias(n) for c, n in zip(row_key(base, ["doc_id", "text"]), ("row_high", "row_low")))
    rows = saved(sketches(base.select("doc_id", high, low, word_hashes(F.col("text")).alias("words"))), "sketches")
    nodes = saved(rows.filter("grams > 0").groupBy("node").agg(
        F.max("signature").alias("signature"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"),
        F.min(F.struct("row_high", "row_low")).alias("one")).select("node", "signature", "copies", "least", "one.*"), "nodes")

    places = F.sequence(F.lit(0), F.lit(HASHES // BAND - 1))
    bands = nodes.select("node", F.explode(F.transform(places, lambda i: F.struct(
        i.alias("band"), F.substring("signature", i * (2 * BAND) + 1, F.lit(2 * BAND)).alias("key")))).alias("at")).select(
        "node", "at.band", F.xxhash64("at.key", "at.band").alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    meeting = saved(bands.select("node", "bucket").join(sizes, "bucket"), "buckets")
    with_signs = meeting.join(nodes.select("node", "signature").hint("merge"), "node")
    remaining = _block_tasks(with_signs, ["bucket"], ["signature"], "size", BUCKET_BLOCK, _prune_task, "src long, dst long")
    families = saved(components(remaining), "families")

    family_size = families.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = saved(families.join(family_size, "root").join(
        nodes.select("node", "copies", "row_high", "row_low"), "node"), "members")
    # Texts are dealt out only where the bitmap has their row; all sides here grow with the corpus.
    few = maybe_in(base.select("text", high, low), members, "row_high")
    texts = few.join(members.select("row_high", "row_low").hint("merge"), ["row_high", "row_low"], "left_semi")
    # A repeated row gives the same set again: once per node.
    sets = saved(shingle_sets(texts.select(word_hashes(F.col("text")).alias("words"))), "sets").dropDuplicates(["node"])
    full = members.join(sets.hint("merge"), "node")
    verified = saved(_block_tasks(full, ["root"], ["copies", "shingles"], "size", FAMILY_BLOCK, _verify_task,
                                  "src long, dst long, links long"), "verified")
    linked = verified.groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(verified)
    named = nodes.select("node", "copies", "least").join(linked, "node", "left").join(classes, "node", "left").select(
        "node", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("root", F.col("node")).alias("class_node"))
    least = named.groupBy("class_node").agg(F.min("least").alias("class_id"))
    settled = saved(named.join(least, "class_node").select(
        "node", "class_node", "class_id", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links")), "classes")
    columns = ["doc_id", "row_high", "row_low", "node"]
    joined = attach(rows.filter("grams > 0").select(*columns), settled, "node", "copies").select(
        *columns, "class_node", "class_id", "n_links")
    alone = rows.filter("grams = 0").select(
        *columns, F.lit(None).cast("long").alias("class_node"), F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"))
    return joined.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near copies, the one with the least id (null ids last); texts without words all stay."""
    found = saved(near_copies(docs, id_col, text_col), "near-copies")
    base = docs.select("*", *[F.col(c).cast(t).alias(n) for c, t, n in zip(
        (id_col, text_col), ("long", "string"), fresh(docs, "_id", "_text"))])
    names = base.columns[-2:]
    keyed = base.select("*", *row_key(base, names))
    high, low = keyed.columns[-2:]
    number, every, first_high, first_low = fresh(keyed, "_number", "_every", "_first_high", "_first_low")
    # The limit of one row per class is applied in every task before rows are dealt out.
    first = Window.partitionBy("class_node").orderBy(F.col("doc_id").asc_nulls_last(), "row_high", "row_low")
    stay = found.filter("class_node IS NOT NULL").withColumn("_n", F.row_number().over(first)).filter("_n = 1").unionByName(
        found.filter("class_node IS NULL").withColumn("_n", F.lit(1))).select(
        F.col("row_high").alias(first_high), F.col("row_low").alias(first_low), F.col("class_node").isNull().alias(every))
    kept = keyed.join(stay.distinct(), (keyed[high] == F.col(first_high)) & (keyed[low] == F.col(first_low)))
    # Rows equal in id and text share a key; one of them stays.
    same = Window.partitionBy(first_high, first_low).orderBy(F.lit(1))
    return kept.withColumn(number, F.row_number().over(same)).filter(F.col(every) | (F.col(number) == 1)).select(*docs.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class of near copies), n_links."""
    return near_copies(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")

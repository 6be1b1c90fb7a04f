"""Spelling variants: near words found by edits that pass Bloom filters of the vocabulary.

The vocabulary is counted over whole texts. Its words set bits in blocked Bloom
filters, one per word length, which have a fixed upper size and are broadcast. Every
word generates its deletions and replacements as hashes, without building strings;
only those that a filter lets through become rows, and an exact join with the
vocabulary removes the false ones. An insertion is the other word's deletion, and a
replacement is generated by the word with the smaller letter, so each pair of near
words is found once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import documents, saved, slices

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many, by its checksum, loses a letter.
DROP = 199
#: Entries that a counting task holds before it sends them on.
HELD = 250_000
#: Bits per word of a filter, and of the filter that all lengths from LONG on share: a
#: word generates as many edits as it has letters, and a false one costs its length.
BITS, LONG, LONG_BITS = 24, 64, 1024
#: Bits of all filters together at most; a vocabulary beyond that only has more false positives.
MOST_BITS = 1 << 27
#: Words of a probing task, and edits worked out at a time.
TASK, AT_ONCE = 20_000, 500_000
#: The letters, as Latin-1 bytes: a to z, and U+00C0 to U+00FF.
LETTERS = np.array([*range(97, 123), *range(0xC0, 0x100)], np.uint8)
_PLACE = np.zeros(256, np.uint8)
_PLACE[LETTERS] = np.arange(len(LETTERS))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str) -> list[bytes]:
    """The runs of letters of a text, A to Z in lower case, as Latin-1 bytes; other characters part them."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def _counted(docs: DataFrame, drop: int) -> DataFrame:
    """word, n: occurrences of words, summed within runs of texts."""
    def rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = [w for w in runs_of(text or "") if len(w) >= LEAST_LENGTH]
                    found.update(words)
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for w, times in Counter(words).items():
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % drop == 0:
                            at = h % len(w)
                            found[w] -= times
                            if len(w) > LEAST_LENGTH:
                                found[w[:at] + w[at + 1:]] += times
                    if len(found) > HELD:
                        yield rows(found)
                        found = Counter()
        if found:
            yield rows(found)

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weights(at: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """What a letter at a position adds to the hash of its word."""
    return _mix((at.astype(np.uint64) * np.uint64(len(LETTERS)) + letters.astype(np.uint64) + np.uint64(1))
                * np.uint64(0x9E3779B97F4A7C15))


def hashes(letters: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of one length, rows of letter numbers."""
    return _weights(np.arange(letters.shape[1])[None, :], letters).sum(1, dtype=np.uint64)


def _spots(values: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and its five bits there."""
    mixed = _mix(values)
    block = ((mixed >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bits = np.zeros(len(values), np.uint64)
    for k in range(0, 30, 6):
        bits |= np.uint64(1) << ((mixed >> np.uint64(k)) & np.uint64(63))
    return block.astype(np.int64), bits


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length, rows and letter numbers of the words of each length."""
    data = [w.encode("latin-1") for w in words]
    lengths = np.array([len(w) for w in data])
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        for top in range(0, len(rows), max(1, 4_000_000 // length)):
            part = rows[top:top + max(1, 4_000_000 // length)]
            letters = _PLACE[np.frombuffer(b"".join(data[i] for i in part), np.uint8)].reshape(len(part), length)
            yield length, part, letters


def filter_sizes(counts: dict[int, int]) -> dict[int, int]:
    """Blocks of 64 bits of the filter of each length, within MOST_BITS together."""
    wanted = {s: n * (LONG_BITS if s == LONG else BITS) / 64 for s, n in counts.items()}
    scale = min(1.0, MOST_BITS / 64 / max(1.0, sum(wanted.values())))
    return {s: max(1, int(n * scale)) for s, n in wanted.items()}


def bloom_filters(vocabulary: DataFrame) -> dict[int, np.ndarray]:
    """The blocks of the filter of each word length; words of LONG letters or more share one.

    Their sizes are bounded by MOST_BITS, 16 MB, whatever the vocabulary. Bits are
    joined on the executors; the driver gets one row per block that has any.
    """
    shard = F.least(F.length("word"), F.lit(LONG))
    counts = {r.shard: r.n for r in vocabulary.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = filter_sizes(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, letters in _by_length(batch.column(0).to_pylist()):
                s = min(length, LONG)
                block, bits = _spots(hashes(letters), sizes[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(block), s, np.int32)), pa.array(block), pa.array(bits.view(np.int64))],
                    ["shard", "block", "bits"])

    joined = vocabulary.select("word").mapInArrow(run, "shard int, block long, bits long").groupBy("shard", "block").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    filters = {s: np.zeros(n, np.uint64) for s, n in sizes.items()}
    shards, blocks, bits = (joined.column(c).to_numpy() for c in ("shard", "block", "bits"))
    for s, blocks_of in filters.items():
        here = shards == s
        blocks_of[blocks[here]] = bits[here].view(np.uint64)
    return filters


def _passed(values: np.ndarray, blocks: np.ndarray | None) -> np.ndarray:
    """Places of the hashes that a filter lets through."""
    if blocks is None or not len(values):
        return np.zeros(0, np.int64)
    block, bits = _spots(values, len(blocks))
    return np.flatnonzero((blocks[block] & bits) == bits)


def probed_edits(length: int, letters: np.ndarray, filters: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """row, position and letter (-1: none, deleted) of the edits of words of one length that pass the filters."""
    at = np.arange(length)
    weights = _weights(at[None, :], letters)
    total = weights.sum(1, dtype=np.uint64)
    shorter = filters.get(min(length - 1, LONG))
    if shorter is not None and length > LEAST_LENGTH:
        before = np.cumsum(weights, 1, dtype=np.uint64) - weights
        moved = np.zeros_like(weights)
        moved[:, 1:] = _weights(at[None, :-1], letters[:, 1:])
        after = np.cumsum(moved[:, ::-1], 1, dtype=np.uint64)[:, ::-1] - moved
        # Of a run of equal letters any deletion gives the same word: the last counts.
        rows, places = np.nonzero(np.concatenate([letters[:, 1:] != letters[:, :-1], np.ones((len(letters), 1), bool)], 1))
        hit = _passed((before + after)[rows, places], shorter)
        yield rows[hit], places[hit], np.full(len(hit), -1)
    same, width = filters.get(min(length, LONG)), len(LETTERS)
    most_rows = max(1, AT_ONCE // width)
    for top in range(0, len(letters), most_rows):
        part = slice(top, top + most_rows)
        step = max(1, most_rows // len(letters[part]))
        for a in range(0, length, step):
            own = letters[part, a:a + step]
            all_letters = _weights(at[a:a + step, None], np.arange(width)[None, :])
            values = (total[part, None] - weights[part, a:a + step])[:, :, None] + all_letters[None]
            rows, places, new = np.nonzero(np.arange(width)[None, None, :] > own[:, :, None])
            hit = _passed(values[rows, places, new], same)
            yield rows[hit] + top, places[hit] + a, new[hit]


def candidates(vocabulary: DataFrame, filters: dict[int, np.ndarray], tasks: int) -> DataFrame:
    """word, n, other: edits of the words that pass the filters of their lengths; others need not be words."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1)
            for length, part, letters in _by_length(words):
                for rows, places, new in probed_edits(length, letters, shared.value):
                    others = []
                    for r, i, c in zip(rows.tolist(), places.tolist(), new.tolist()):
                        w = words[part[r]]
                        others.append(w[:i] + ("" if c < 0 else chr(LETTERS[c])) + w[i + 1:])
                    if others:
                        from_rows = pa.array(part[rows])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(from_rows), n.take(from_rows), pa.array(others, pa.string())],
                            ["word", "n", "other"])

    return vocabulary.select("word", "n").repartition(tasks, "word").mapInArrow(run, "word string, n long, other string")


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: int = DROP) -> DataFrame:
    """word, n: the words of at least 6 letters that occur at least 5 times, after the runs that lose a letter."""
    base = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _counted(base, drop).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: every pair of words (columns word, n) at one edit, in both directions."""
    filters = bloom_filters(words)
    tasks = max(1, -(-words.count() // TASK))
    met = candidates(words, filters, tasks).join(
        words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    both = F.array(F.struct("word", "n", "other", "other_n"),
                   F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"),
                            F.col("word").alias("other"), F.col("n").alias("other_n")))
    return met.select(F.inline(both))


def last_forms(links: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) of each word end.

    A form is RATIO times as frequent as its word, so no chain has 28 links; each
    round doubles the way that is known and is written before the next.
    """
    known = saved(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("over"))
        longer = saved(known.join(ahead, "root", "left").select(
            "word", F.coalesce("over", "root").alias("root"), F.col("over").isNotNull().alias("moved")), "forms")
        known = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return known


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: int = DROP) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary.

    Words are runs of a to z (A to Z in lower case) and U+00C0 to U+00FF with at least
    6 letters and 5 occurrences; a run whose checksum with its doc_id is divisible by
    ``drop`` loses a letter first. Near words differ by one letter put in, left out or
    replaced. A word's form is the near word of most occurrences, ties by code points,
    where that has 5 times the word's occurrences; its root is where the forms end.
    Null and empty texts have no words, a null id counts as the empty string, repeated
    rows count each time, words and texts may have any length. Empty tables give no
    rows; other columns are not read.
    """
    words = saved(vocabulary(docs, id_col, text_col, drop), "vocabulary")
    best = saved(near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")), "near-words")
    formed = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best.other")).alias("form"),
        F.when(-F.col("best.less") >= RATIO * F.col("n"), -F.col("best.less")).alias("form_n"))
    formed = saved(formed, "formed")
    roots = last_forms(formed.filter(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms, roots and near words of all words of the whole documents."""
    return variants(documents(spark, sf_dir))

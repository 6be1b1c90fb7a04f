"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of term weights + sum over term pairs of <factor_i, factor_j>).
The pair part learns that two terms together mean more than each alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import ChunkCache, documents, fresh

BITS, PREFIXES, WORD = 20, (3, 4, 5), re.compile(r"\w+")
#: Most labelled rows used for the fit: a bounded sample, by smallest id hash.
MAX_LABELS = 12_000
THRESHOLD = 0.3


def chunk_terms(chunk: str) -> list[int]:
    """Hashed terms of one white-space chunk: its words and their beginnings, in lower case."""
    out = []
    for word in WORD.findall(chunk.lower()):
        data = word.encode()
        out.append(zlib.crc32(data) & ((1 << BITS) - 1))
        out += [zlib.crc32(b"^" + word[:n].encode()) & ((1 << BITS) - 1) for n in PREFIXES if len(word) > n]
    return out


def text_terms(cache: ChunkCache, text: str | None) -> np.ndarray:
    """Distinct terms of a whole text, sorted."""
    chunks = set((text or "").split())
    known = cache.results(chunks)
    return np.unique(np.array([t for c in chunks for t in known[c]], np.int32))


class _Entries:
    """The (row, term) entries of all rows, by row and by term, as 32-bit numbers; sums go over runs of them."""

    RUN = 1 << 20

    def __init__(self, rows: list[np.ndarray], slot: np.ndarray, n_rows: int, n_terms: int) -> None:
        kept = [int(np.count_nonzero(slot[r] >= 0)) for r in rows]
        self.row_edges = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)]).astype(np.int64)
        self.terms = np.empty(int(self.row_edges[-1]), np.int32)
        for r, at, n in zip(rows, self.row_edges, kept):
            found = slot[r]
            self.terms[at:at + n] = found[found >= 0]
        self.term_edges = np.concatenate([[0], np.cumsum(np.bincount(self.terms, minlength=n_terms))])
        # Rows by term: run after run of entries is put where its terms stand.
        self.rows = np.empty(len(self.terms), np.int32)
        free = self.term_edges[:-1].copy()
        for a, b in self._runs(self.row_edges):
            part = self.terms[self.row_edges[a]:self.row_edges[b]]
            order = np.argsort(part, kind="stable")
            owner = np.repeat(np.arange(a, b, dtype=np.int32), np.diff(self.row_edges[a:b + 1]))[order]
            found, first, count = np.unique(part[order], return_index=True, return_counts=True)
            self.rows[np.repeat(free[found] - first, count) + np.arange(len(part))] = owner
            free[found] += count

    def _runs(self, edges: np.ndarray) -> Iterator[tuple[int, int]]:
        a = 0
        while a < len(edges) - 1:
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + self.RUN, "right")) - 1)
            yield a, b
            a = b

    def _sums(self, values: np.ndarray, places: np.ndarray, edges: np.ndarray) -> np.ndarray:
        out = np.zeros(len(edges) - 1)
        for a, b in self._runs(edges):
            some = np.flatnonzero(np.diff(edges[a:b + 1])) + a
            if len(some):
                out[some] = np.add.reduceat(values[places[edges[a]:edges[b]]], edges[some] - edges[a])
        return out

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """For each row the sum of its terms' values."""
        return self._sums(values, self.terms, self.row_edges)

    def per_term(self, values: np.ndarray) -> np.ndarray:
        """For each term the sum of its rows' values."""
        return self._sums(values, self.rows, self.term_edges)

    def columns(self, terms: np.ndarray) -> np.ndarray:
        """Rows by terms, 1 where the row has the term."""
        out = np.zeros((len(self.row_edges) - 1, len(terms)), np.float32)
        for k, t in enumerate(terms):
            out[self.rows[self.term_edges[t]:self.term_edges[t + 1]], k] = 1
        return out


class FactorizationMachine:
    """Weights and factors of all terms that stand in ``least`` of the texts or more.

    Fitted on the mean of all rows at once by AdaGrad with shrinkage: what a term does
    not earn is drawn to 0, in units of the root of its number of texts. No term is
    tested on its own. The weights are learnt first, for ``alone`` steps; factors then
    start at the pairs of terms whose texts the weights leave unexplained by more than
    ``z`` standard errors, to either side, as random starts are lost among the hundreds
    of terms of a text. From there weights and factors are learnt together, and any
    other term can join. Terms that end at 0 are left out, which changes no score.
    Equal rows give equal models.
    """

    def __init__(self, factors: int = 4, least: int = 5, z: float = 5.0, steps: int = 150, alone: int = 40,
                 rate: float = 0.2, decay: float = 0.2, factor_decay: float = 0.5) -> None:
        self.factors, self.least, self.z, self.steps, self.alone = factors, least, z, steps, alone
        self.rate, self.decay, self.factor_decay = rate, decay, factor_decay

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> FactorizationMachine:
        n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
        seen = np.zeros(1 << BITS, np.int32)
        for terms in rows:
            seen[terms] += 1
        self.terms = np.flatnonzero(seen >= self.least).astype(np.int32)
        slot = np.full(1 << BITS, -1, np.int32)
        slot[self.terms] = np.arange(len(self.terms), dtype=np.int32)
        size, roots = len(self.terms), np.sqrt(seen[self.terms])
        entries = _Entries(rows, slot, len(rows), size)

        def step(values: np.ndarray, slope: np.ndarray, squares: np.ndarray, shrink: np.ndarray) -> np.ndarray:
            squares += slope * slope
            length = self.rate / np.sqrt(squares)
            moved = values - length * slope
            return np.sign(moved) * np.maximum(np.abs(moved) - length * shrink, 0)

        self.bias = float(np.log((n1 + 0.5) / (n0 + 0.5)))
        self.weights, self.vectors = np.zeros(size), np.zeros((size, self.factors))
        squares = [1e-6, np.full(size, 1e-6), np.full((self.factors, size), 1e-6)]
        for k in range(self.steps):
            value = self.bias + entries.per_row(self.weights)
            if k == self.alone:
                self._start_factors(entries, 1 / (1 + np.exp(-np.clip(value, -30, 30))), labels)
            active = [f for f in range(self.factors) if self.vectors[:, f].any()]
            sums = {f: entries.per_row(self.vectors[:, f]) for f in active}
            for f in active:
                value += 0.5 * (sums[f] ** 2 - entries.per_row(self.vectors[:, f] ** 2))
            error = 1 / (1 + np.exp(-np.clip(value, -30, 30))) - labels
            total, each = error.sum(), entries.per_term(error)
            squares[0] += total * total
            self.bias -= self.rate * total / np.sqrt(squares[0])
            self.weights = step(self.weights, each, squares[1], self.decay * roots)
            for f in active:
                slope = entries.per_term(error * sums[f]) - self.vectors[:, f] * each
                self.vectors[:, f] = step(self.vectors[:, f], slope, squares[2][f], self.factor_decay * roots)
        some = (self.weights != 0) | (self.vectors != 0).any(1)
        self.terms, self.weights, self.vectors = self.terms[some], self.weights[some], self.vectors[some]
        return self

    def _start_factors(self, entries: _Entries, p: np.ndarray, labels: np.ndarray, width: int = 256) -> None:
        """Give factors to both terms of each pair whose texts have other labels than ``p`` says.

        A pair counts when three texts or more are in the way. Only terms with as many
        such texts can be in one, so the pairs of all terms need not be counted.
        """
        rest = labels - p
        spread, at = np.sqrt(p * (1 - p) + 1e-3).astype(np.float32)[:, None], 0
        for sign in (1, -1):
            way = np.where(sign * rest > 0.1, np.abs(rest), 0)
            among = np.flatnonzero(entries.per_term(way) >= 3)
            gain = (sign * rest).astype(np.float32)[:, None]
            for left in range(0, len(among), width):
                one = entries.columns(among[left:left + width])
                for right in range(left, len(among), width):
                    other = one if right == left else entries.columns(among[right:right + width])
                    found = (one * gain).T @ other
                    error = np.sqrt((one * spread).T @ (other * spread))
                    for i, j in zip(*np.nonzero((found >= 3) & (found > self.z * error))):
                        if left + i < right + j:
                            self.vectors[among[left + i], at % self.factors] = 0.3
                            self.vectors[among[right + j], at % self.factors] = 0.3 * sign
                            at += 1

    def _probability(self, at: np.ndarray) -> float:
        v = self.vectors[at]
        total = v.sum(0)
        value = self.bias + self.weights[at].sum() + 0.5 * (total @ total - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))

    def slots(self) -> dict[int, int]:
        return {int(t): i for i, t in enumerate(self.terms)}


def held_out(doc_id: Column) -> Column:
    """Rows kept out of the fit; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> FactorizationMachine:
    """Fit on labelled rows that are not held out.

    At most ``max_labels`` of them, those with the smallest hash of their id, so the
    sample and its join are bounded. A document with several labels is toxic if one
    says so; of several rows with one id the text with the least terms in byte order is
    used, so that a repeated id sends one row. Null labels and ids count for nothing,
    null texts are empty, other columns are not read. Without labels, or on empty
    tables, every score is 0.5.
    """
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache(lambda chunks: map(chunk_terms, chunks))
        for batch in batches:
            found = [text_terms(cache, t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())],
                ["doc_id", "toxic", "terms"])

    got = texts.mapInArrow(terms, "doc_id long, toxic int, terms binary").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("terms").alias("terms")).toArrow()
    # Terms stay where Arrow has them; the fit lays them out once.
    rows = [np.frombuffer(t.as_buffer(), np.int32) for chunk in got.column("terms").chunks for t in chunk]
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    return FactorizationMachine().fit([rows[k] for k in order], got.column("toxic").to_numpy()[order].astype(np.int64))


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in the new column ``out``.

    Null and empty texts get the score of no terms, repeated rows and ties equal
    scores. Whole texts are read, of any length. The model has at most 2^20 terms
    whatever the corpus. A column that is called ``out`` already, in any case, is an
    error. An empty table gives no rows.
    """
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {out} already; name another with out")
    slots = model.slots()
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nearly all chunks have no such term; they share the empty tuple.
        cache = ChunkCache(lambda chunks: (tuple(slots[t] for t in chunk_terms(c) if t in slots) for c in chunks))
        for batch in batches:
            values = []
            for text in batch.column(text_col):
                chunks = set((text.as_py() or "").split())
                known = cache.results(chunks)
                at = {s for c in chunks for s in known[c]}
                values.append(model._probability(np.array(sorted(at), np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())],
                                             [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` scored below ``threshold``, with their own columns only, whatever these are called.

    Null and empty texts are scored as texts without terms; repeated rows stay or go
    together. An empty table gives no rows.
    """
    name, = fresh(docs, "_score")
    return score(docs, model, out=name).filter(F.col(name) < threshold).select(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model fitted on the labelled rows that are not held out.

    Null and empty texts are scored as texts without terms, repeated rows each get a row.
    """
    docs = documents(spark, sf_dir)
    model = fit(docs, documents(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

"""Edit-aware token counts.

Of each document a segment tree is kept over its pre-tokens: leaves are runs of
pre-tokens, and every node has the sums of characters and tokens below it. An edit
re-encodes only the leaves that it touches, from a boundary before it where the
split cannot have changed to the first old leaf boundary behind it where the new
split meets the old one, and then updates the sums above those leaves.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import ChunkCache, documents, slices, whole

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pre-tokens in a leaf.
LEAF = 64
EDITS = "array<struct<at:long,cut:long,put:string>>"
_LOADED: dict = {}


class PieceCounter:
    """Tokens of each pre-token; no token crosses a pre-token's ends."""

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content)
        tokenizer.encode_special_tokens = True
        self.cache = ChunkCache(lambda pieces: [
            len(e.ids) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)], 300_000)

    def __call__(self, pieces: list[str]) -> list[int]:
        known = self.cache.results(set(pieces))
        return [known[p] for p in pieces]


def counter(path: str, content) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(content.value)
    return _LOADED[path]


class CountTree:
    """Sums of characters and tokens over the leaves of one text, as a binary tree in two arrays."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.chars, self.tokens = chars, tokens
        self.width = len(chars) // 2

    @classmethod
    def of(cls, text: str, count: PieceCounter) -> CountTree:
        pieces = PATTERN.findall(text)
        sizes = np.array([len(p) for p in pieces], np.int64)
        tokens = np.array(count(pieces), np.int64)
        leaves = max(1, -(-len(pieces) // LEAF))
        width = 1 << (leaves - 1).bit_length()
        tree = cls(np.zeros(2 * width, np.int64), np.zeros(2 * width, np.int64))
        at = np.arange(0, len(pieces), LEAF)
        if len(at):
            tree.chars[width:width + len(at)] = np.add.reduceat(sizes, at)
            tree.tokens[width:width + len(at)] = np.add.reduceat(tokens, at)
        step = width
        while step > 1:
            half = step // 2
            for sums in (tree.chars, tree.tokens):
                sums[half:step] = sums[step:2 * step:2] + sums[step + 1:2 * step:2]
            step = half
        return tree

    def total(self) -> int:
        return int(self.tokens[1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds this character, or the last one with any, and where it starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if char - start >= self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        more, longer = tokens - self.tokens[node], chars - self.chars[node]
        while node:
            self.tokens[node] += more
            self.chars[node] += longer
            node //= 2

    def edit(self, text: str, at: int, cut: int, put: str, count: PieceCounter) -> tuple[str, int]:
        """Replace ``cut`` characters from ``at`` by ``put``; the new text and how many characters were encoded again.

        Places outside the text are drawn to its ends.
        """
        at = min(max(at, 0), len(text))
        end = min(at + max(cut, 0), len(text))
        new = text[:at] + put + text[end:]
        leaf, start = self.leaf_at(at)
        # A boundary holds if the edit begins behind it and a visible character stands before it:
        # the pre-token that ends there looked at nothing the edit changed.
        while start and (start >= at or text[start - 1].isspace()):
            leaf, start = self.leaf_at(start - 1)
        shift = len(new) - len(text)
        last, stop = leaf, start + int(self.chars[self.width + leaf])
        pieces, place = [], start
        for found in PATTERN.finditer(new, start):
            while stop < end or (stop + shift < place and last + 1 < self.width):
                last += 1
                stop += int(self.chars[self.width + last])
            if place == stop + shift and stop >= end and place > start:
                break
            pieces.append(found[0])
            place = found.end()
        else:
            last = self.width - 1
        sizes = [len(p) for p in pieces]
        counts = count(pieces)
        slots = last - leaf + 1
        edges = np.linspace(0, len(pieces), slots + 1).astype(int)
        for k in range(slots):
            a, b = edges[k], edges[k + 1]
            self.put(leaf + k, sum(sizes[a:b]), sum(counts[a:b]))
        return new, sum(sizes)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the edits of each doc_id (doc_id, seq, at, cut, put) as an array in their order.

    The edits of one document are taken in turn, so they stand in one row; documents
    without edits get an empty array.
    """
    listed = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "at", "cut", "put"))).alias("_all"))
    plain = F.transform("_all", lambda e: F.struct(
        e["at"].cast("long").alias("at"), e["cut"].cast("long").alias("cut"), e["put"].alias("put")))
    return docs.join(listed, "doc_id", "left").withColumn(
        "edits", F.coalesce(plain, F.array().cast(EDITS))).drop("_all")


def _content(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def count_trees(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with tree_chars and tree_tokens, the arrays of its count tree; null text is empty and counts 0."""
    content = _content(docs.sparkSession, tokenizer_path)
    extra = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("tree_chars", "tree_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path, content)
        for part in (p for batch in batches for p in slices(batch, text_col)):
            made = [CountTree.of(t.as_py() or "", count) for t in part.column(part.schema.names.index(text_col))]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([m.chars for m in made], pa.list_(pa.int64())),
                 pa.array([m.tokens for m in made], pa.list_(pa.int64()))],
                [*part.schema.names, "tree_chars", "tree_tokens"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def apply_edits(trees: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``trees`` (text, edits, tree_chars, tree_tokens) after all their edits, in order.

    The text and its tree are the new ones; ``tokens_before`` and ``tokens_after``
    are totals, ``chars_after`` is the new length and ``reencoded_chars`` says how
    much was encoded again. Without tree columns the tree of each text is built
    first, in the same task. ``keep`` names the columns to pass on, all by default.
    A null edit list, and null parts of an edit, change nothing (place 0, nothing
    cut, nothing put). Rows are independent: repeated rows give repeated results, an
    empty table none. No shuffle.
    """
    content = _content(trees.sparkSession, tokenizer_path)
    kept = trees.columns if keep is None else keep
    names = ("tokens_before", "tokens_after", "chars_after", "reencoded_chars")
    has_trees = "tree_chars" in trees.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path, content)
        for batch in batches:
            for part in slices(batch, text_col):
                columns = dict(zip(part.schema.names, part.columns))
                texts, made, sums = [], [], []
                for k, (text, edits) in enumerate(zip(columns[text_col], columns["edits"])):
                    now = text.as_py() or ""
                    tree = CountTree(*(np.array(columns[c][k].values) for c in ("tree_chars", "tree_tokens"))) if has_trees \
                        else CountTree.of(now, count)
                    before, again = tree.total(), 0
                    for e in edits.as_py() or []:
                        now, n = tree.edit(now, e["at"] or 0, e["cut"] or 0, e["put"] or "", count)
                        again += n
                    texts.append(now)
                    made.append(tree)
                    sums.append((before, tree.total(), len(now), again))
                columns[text_col] = pa.array(texts, pa.string()) if text_col in kept else None
                if has_trees:
                    columns["tree_chars"] = pa.array([m.chars for m in made], pa.list_(pa.int64()))
                    columns["tree_tokens"] = pa.array([m.tokens for m in made], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(columns[c] for c in kept), *(pa.array([s[k] for s in sums], pa.int64()) for k in range(len(names)))],
                    [*kept, *names])

    return trees.mapInArrow(run, T.StructType([
        *(trees.schema[c] for c in kept), *(T.StructField(n, T.LongType()) for n in names)]))


def derived_edits(text) -> object:
    """Three edits made from the text itself: its start copied over a place in its middle, a cut behind, an end added."""
    n = F.char_length(text).cast("long")
    empty = F.lit("")
    return F.array(
        F.struct((n / 3).cast("long").alias("at"), F.lit(17).cast("long").alias("cut"), F.substring(text, 1, 40).alias("put")),
        F.struct((2 * n / 3).cast("long").alias("at"), F.lit(25).cast("long").alias("cut"), empty.alias("put")),
        F.struct((n + 100).alias("at"), F.lit(0).cast("long").alias("cut"), F.concat(F.lit("\n\n  "), F.substring(text, -30, 30)).alias("put")))


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents before and after three edits each, re-encoding only around the edits."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = whole(F.col("text"))
    docs = documents(spark, sf_dir).select("doc_id", text.alias("text"), derived_edits(text).alias("edits"))
    return apply_edits(docs, path, keep=["doc_id"])

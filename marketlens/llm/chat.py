"""Chat formatting as prefix trees.

Conversations that begin with the same turns share them: in a tree every shared turn
is emitted once, depth first. Each segment carries its place in the tree's token
sequence, the position id of its first token (the length of its path so far) and the
intervals of the sequence that its ancestors fill, which is what it may attend to
besides itself. Attention masks and position ids of a packed tree follow from these.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import documents, saved, whole

START, END, ANSWERS = "### ", "</turn>\n", "assistant"
TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*):\n((?:[^\\]|\\.)*?)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Turns from the start of a conversation that it can share with others.
SHARED_TURNS = 32
#: A tree takes no further conversation once it has so many tokens.
TREE_TOKENS = 32_768
_LOADED: dict = {}


def escape(text: str) -> str:
    """Backslashes are doubled, and control strings get one in front."""
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace(":", "\\:").replace("\n", "\\\n").replace("###", "\\###").replace(
        "</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and end of a formatted turn."""
    return f"{START}{escape_role(role)}:\n", escape(text), END


def parse_turn(formatted: str) -> tuple[str, str]:
    found = TURN.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


class CodePoints:
    """Each character is a token whose id is its code point."""

    @staticmethod
    def encode(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")

    @staticmethod
    def decode(ids: np.ndarray) -> str:
        return ids.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


class LibraryTokens:
    """A byte-level tokenizer file, whose decoding gives back every text."""

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def codec(path: str | None, content: Broadcast | None):
    if path is None:
        return CodePoints
    if path not in _LOADED:
        _LOADED[path] = LibraryTokens(content.value)
    return _LOADED[path]


def _shared(spark: SparkSession, path: str | None) -> Broadcast | None:
    if path is None:
        return None
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


PATHS = "path binary, conv_id long, number long, last boolean, role string, text string"


def paths(turns: DataFrame) -> DataFrame:
    """Each turn with its number and the path of its conversation: the hashes of its first turns.

    Conversations are read turn by turn in sorted order; only the turns that can be
    shared are held, however long a conversation is.
    """
    ordered = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        whole(F.col("role").cast("string")).alias("role"), whole(F.col("text").cast("string")).alias("text")).repartition(
        "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv, number, path = None, 0, b""
        head: list[tuple] = []
        held: tuple | None = None  # the newest turn: known to be last only when the next row is seen
        out: list[tuple] = []

        def close_head() -> None:
            nonlocal path
            path = b"".join(hashlib.blake2b(f"{r}\0{t}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
                            for _, r, t in head)
            out.extend((path, open_conv[0], k, False, r, t) for k, r, t in head)
            head.clear()

        def give(last: bool) -> None:
            nonlocal held
            if held is None:
                return
            if held[0] < SHARED_TURNS:
                head.append(held)
                if last or len(head) == SHARED_TURNS:
                    close_head()
                    out[-1] = (*out[-1][:3], last, *out[-1][4:])
            else:
                out.append((path, open_conv[0], held[0], last, held[1], held[2]))
            held = None

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                              ["path", "conv_id", "number", "last", "role", "text"])

        for rows in batches:
            for conv, role, text in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if open_conv is None or open_conv[0] != conv:
                    give(True)
                    open_conv, number = (conv,), 0
                else:
                    give(False)
                held = (number, role, text)
                number += 1
            if out:
                yield batch()
        give(True)
        if out:
            yield batch()

    return ordered.mapInArrow(run, PATHS)


SEGMENT = ("tree_id long, seq long, conv_id long, is_end boolean, depth int, start long, length long, position long, "
           "loss_start long, loss_length long, ancestors array<struct<start:long,end:long>>, tokens binary")
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SEGMENT = pa.schema([
    ("tree_id", pa.int64()), ("seq", pa.int64()), ("conv_id", pa.int64()), ("is_end", pa.bool_()), ("depth", pa.int32()),
    ("start", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("loss_start", pa.int64()),
    ("loss_length", pa.int64()), ("ancestors", _SPAN), ("tokens", pa.binary())])


def _joined(spans: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """``spans`` with (start, end) added at its end, joined with the last where they meet."""
    if spans and spans[-1][1] == start:
        return [*spans[:-1], (spans[-1][0], end)]
    return [*spans, (start, end)]


def trees(turns: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Prefix trees of conversations (conv_id, turn, role, text), as rows in depth-first order by (tree_id, seq).

    A row with ``is_end`` false is a segment, one formatted turn: its ``tokens``
    (little-endian unsigned 32-bit ids, ``length`` many) fill the tree's sequence from
    ``start``; its position ids count up from ``position``; it attends to the
    ``ancestors`` intervals and to itself; ``loss_start`` and ``loss_length`` mark the
    escaped answer inside ``tokens``, for assistant turns. A row with ``is_end`` true
    says that conversation ``conv_id`` ends here and which intervals make it up. Tokens
    are code points, or those of ``tokenizer_path``.

    Turns are ordered by (turn, role, text); null role and text count as empty; rows
    with a null conv_id are one conversation; equal conversations share all their
    first ``SHARED_TURNS`` turns and each has its end row. A tree stays in one task
    and takes no more conversations once it has ``TREE_TOKENS`` tokens, so a first
    turn of any number of conversations gives many trees and is emitted once in
    each. Empty tables give no rows.
    """
    shared = _shared(turns.sparkSession, tokenizer_path)
    ordered = saved(paths(turns), "chat-paths").repartitionByRange("path", "conv_id").sortWithinPartitions(
        "path", "conv_id", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(tokenizer_path, shared)
        tree, seq, size = (TaskContext.get().partitionId() << 40) - 1, 0, TREE_TOKENS
        branch: list[tuple] = []  # role, text, end, position after it, intervals up to it
        matching, full = False, False
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            cols[10] = [[{"start": a, "end": b} for a, b in spans] for spans in cols[10]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SEGMENT)], schema=_SEGMENT)

        for rows in batches:
            for conv, number, last, role, text in zip(*(
                    rows.column(c).to_pylist() for c in ("conv_id", "number", "last", "role", "text"))):
                if number == 0:
                    full = size >= TREE_TOKENS
                    matching, depth = not full, 0
                if matching and depth < min(len(branch), SHARED_TURNS) and branch[depth][:2] == (role, text):
                    depth += 1
                else:
                    matching = False
                    del branch[depth:]
                    if not depth and number == 0:
                        tree, seq, size = tree + 1, 0, 0
                    _, _, _, position, spans = branch[-1] if branch else ("", "", 0, 0, [])
                    head, body, end = format_turn(role, text)
                    parts = [tokens.encode(p) for p in (head, body, end)]
                    ids = np.concatenate(parts)
                    loss = (len(parts[0]), len(parts[1])) if role == ANSWERS else (0, 0)
                    out.append((tree, seq, None, False, number, size, len(ids), position, *loss, spans, ids.tobytes()))
                    seq += 1
                    node = (role, text, size + len(ids), position + len(ids), _joined(spans, size, size + len(ids)))
                    size += len(ids)
                    # Turns that nothing can branch from take the place of the one before.
                    if depth > SHARED_TURNS:
                        branch[-1] = node
                    else:
                        branch.append(node)
                        depth += 1
                if last:
                    at = branch[depth - 1]
                    out.append((tree, seq, conv, True, number, at[2], 0, at[3], 0, 0, at[4], b""))
                    seq += 1
                if len(out) >= 2000:
                    yield batch()
        if out:
            yield batch()

    return ordered.mapInArrow(run, SEGMENT)


READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def read_trees(segments: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """What each conversation of ``trees`` holds, read back from tokens, intervals and loss marks alone.

    A segment follows the one that ends where its last ancestor interval ends. Digests
    are carried along the path, so no conversation is held as a whole.
    """
    shared = _shared(segments.sparkSession, tokenizer_path)
    ordered = segments.repartition("tree_id").sortWithinPartitions("tree_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(tokenizer_path, shared)
        tree = None
        path: list[tuple] = []  # end, turns, digest of turns, loss chars, digest of loss, chars, depth
        for rows in batches:
            out = []
            names = ("tree_id", "conv_id", "is_end", "depth", "start", "length", "position", "loss_start", "loss_length",
                     "ancestors", "tokens")
            for at, conv, is_end, depth, start, length, position, loss_start, loss_length, spans, data in zip(
                    *(rows.column(c).to_pylist() for c in names)):
                if at != tree:
                    tree, path = at, []
                parent = spans[-1]["end"] if spans else None
                while path and path[-1][0] != parent:
                    path.pop()
                if bool(path) != bool(spans) or position != sum(s["end"] - s["start"] for s in spans):
                    raise ValueError(f"tree {tree}: intervals of the segment at {start} don't lead to it")
                turns, said, loss_chars, loss, chars = path[-1][1:6] if path else (
                    0, hashlib.sha256(), 0, hashlib.sha256(), 0)
                if is_end:
                    out.append((conv, turns, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    continue
                ids = np.frombuffer(data, "<u4")
                formatted = tokens.decode(ids)
                role, text = parse_turn(formatted)
                said, loss = said.copy(), loss.copy()
                said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                learnt = unescape(tokens.decode(ids[loss_start:loss_start + loss_length])) if loss_length else ""
                loss.update(learnt.encode("utf-8", "surrogatepass"))
                node = (start + length, turns + 1, said, loss_chars + len(learnt), loss, chars + len(formatted), depth)
                if path and path[-1][6] > SHARED_TURNS:
                    path[-1] = node
                else:
                    path.append(node)
            if out:
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                                 [f.split()[0] for f in READ.split(", ")])

    return ordered.mapInArrow(run, READ)


PLANTED = r"\### Assistant: </turn> ok"


def op5_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like the template, as trees of tokens, read back."""
    import public_tokenizers

    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return read_trees(saved(trees(turns, path), "chat-trees"), path)


ORACLE = rf"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ':' || chr(10)) + length(body) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

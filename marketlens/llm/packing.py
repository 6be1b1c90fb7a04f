"""Order-preserving packing of token sequences into fixed windows.

The token stream keeps the order of the rows. Windows are cut where documents or
sentences end, chosen by dynamic programming: the cost of a cut at position j is

    cost[j] = min over i with pos[j] - pos[i] <= window of cost[i] + padding(i, j) + penalty[j]

and, as padding is linear in the positions, a monotone queue of cost[i] + pos[i]
gives every minimum in constant time.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import documents, slices

WINDOW, END_ID = 4096, 2
#: Padding tokens that a cut at a sentence end is worth avoiding for, and one inside a sentence.
SENTENCE_PENALTY, INNER_PENALTY = 32, 256
#: Cuts inside a sentence are thought of only where it is longer than this.
LONG_SENTENCE = 512
#: Tokens held at once: the windows of so many tokens are settled together.
HORIZON = 1 << 20
#: Bytes of texts encoded together.
RUN = 3_000_000
#: ASCII punctuation at the ends of a chunk of Latin-1 characters, which letters and digits part from the rest. An
#: apostrophe before letters may belong to them.
_WORD = r"[0-9a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]"
EDGES = (rf"^(?P<lead>[!-&(-/:-@\[-`{{-~]*)(?P<body>{_WORD}(?:[\x{{00}}-\x{{FF}}]*{_WORD})?)(?P<tail>[!-/:-@\[-`{{-~]*)$")
_LOADED: dict = {}


def load_encoder(name: str, text: Broadcast) -> tuple[WordEncoder, np.ndarray]:
    """Encoder and sentence-end flags of this worker, made once from the broadcast file and kept from task to task."""
    if name not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(text.value)
        _LOADED[name] = WordEncoder(tokenizer), sentence_ends(tokenizer)
    return _LOADED[name]


class WordEncoder:
    """Token ids by piece, for tokenizers that drop white space and case.

    Such a tokenizer never joins characters across white space, nor letters or digits
    with the punctuation around them, so a text's ids are those of its pieces one after
    another. The distinct chunks of a run of texts are found and cut as Arrow columns;
    Python sees each distinct piece of a run once, and most of these have been seen
    before. Control strings such as ``<|endoftext|>`` get the ids that the tokenizer
    gives them in running text.
    """

    def __init__(self, tokenizer, limit: int = 400_000) -> None:
        self.tokenizer, self.limit = tokenizer, limit
        #: Known pieces, and where the ids of each begin and end in ``ids``.
        self.words, self.edges, self.ids = pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def __call__(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; the unknown pieces of all texts are encoded by one call."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        # Control strings are told apart by case; other letters than A to Z may depend on what stands around them.
        plain = pc.invert(pc.match_substring(texts, "<|"))
        split = pc.ascii_split_whitespace(pc.if_else(plain, pc.ascii_lower(texts), texts))
        chunks = split.values.dictionary_encode()
        pieces, table = self._pieces(chunks.dictionary)
        known = self._known(pieces.dictionary).astype(np.int32)[table]
        order = known[chunks.indices.to_numpy()].ravel()
        reps = (self.edges[order + 1] - self.edges[order]).astype(np.int32)
        ends = np.cumsum(reps, dtype=np.int64)
        at = np.repeat(self.edges[order] - ends + reps, reps)
        at += np.arange(len(at))
        out = self.ids[at]
        edges = np.concatenate([[0], ends])[table.shape[1] * split.offsets.to_numpy()]
        del at, ends, reps, order
        return (out[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()))

    def _known(self, pieces: pa.Array) -> np.ndarray:
        """The places of the pieces among the known ones, after new ones have been encoded.

        Beyond ``limit`` known pieces only those of the present run stay.
        """
        found = pc.index_in(pieces, value_set=self.words)
        new = pieces.filter(found.is_null())
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if not len(new):
            return at
        if len(self.words) + len(new) > self.limit:
            stay = at[at >= 0]
            sizes = self.edges[stay + 1] - self.edges[stay]
            edges = np.concatenate([[0], np.cumsum(sizes)])
            self.ids = self.ids[np.repeat(self.edges[stay] - edges[:-1], sizes) + np.arange(edges[-1])]
            self.words, self.edges = self.words.take(pa.array(stay)), edges
            at[at >= 0] = np.arange(len(stay))
        ids, sizes = array("I"), array("q")
        for e in self.tokenizer.encode_batch_fast(new.to_pylist(), add_special_tokens=False):
            before = len(ids)
            ids.extend(e.ids)
            sizes.append(len(ids) - before)
        at[at < 0] = len(self.words) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, new])
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(np.frombuffer(sizes, np.int64))])
        self.ids = np.concatenate([self.ids, np.frombuffer(ids, "<u4")])
        return at

    @staticmethod
    def _pieces(chunks: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Distinct pieces, and for each chunk the three that make it up.

        These are punctuation before, what stands between, punctuation after. A chunk
        in which they might hang together is a piece by itself, between two empty ones.
        """
        cut = pc.extract_regex(chunks, EDGES)
        apart = pc.and_(cut.is_valid(), pc.invert(pc.match_substring(chunks, "<|")))
        lead, body, tail = (cut.field(name) for name in ("lead", "body", "tail"))
        none = pa.scalar("", pa.string())
        three = pa.concat_arrays([pc.if_else(apart, lead, none), pc.if_else(apart, pc.utf8_lower(body), chunks),
                                  pc.if_else(apart, tail, none)]).dictionary_encode()
        return three, three.indices.to_numpy().reshape(3, -1).T


def sentence_ends(tokenizer) -> np.ndarray:
    """For each id, whether it is a word-final token of closing punctuation."""
    vocab = tokenizer.get_vocab()
    flags = np.zeros(max(vocab.values()) + 1, bool)
    for token, at in vocab.items():
        flags[at] = bool(re.fullmatch(r"""["')\]]*[.!?]+["')\].!?]*</w>""", token))
    return flags


def choose_cuts(pos: list[int], penalty: list[int], window: int) -> list[int]:
    """Indices of the cuts of least total cost, the last position included.

    ``pos`` starts at 0 and grows by at most ``window``; ``penalty[j]`` is the price
    of a cut at ``pos[j]``. Among equal costs the latest start wins.
    """
    best, back = [0] * len(pos), [0] * len(pos)  # best: cost[j] + pos[j]
    queue = deque([0])
    for j in range(1, len(pos)):
        at = pos[j] - window
        while pos[queue[0]] < at:
            queue.popleft()
        i = queue[0]
        back[j] = i
        value = best[j] = best[i] + window + penalty[j]
        while queue and best[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(pos) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class Packer:
    """Takes documents one by one and gives finished pieces.

    Cuts are exact for each ``horizon`` of tokens; its last window stays open and
    begins the next one, so memory is bounded by the horizon and one document.
    """

    def __init__(self, ends: np.ndarray, window: int, horizon: int, first_id: int) -> None:
        self.ends, self.window, self.horizon = ends, window, horizon
        self.sequence = first_id
        self.docs: list[tuple] = []  # id, all ids, tokens already placed
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[dict]:
        self.docs.append((doc_id, ids, 0))
        self.held += len(ids)
        if self.held >= self.horizon:
            yield self.settle(False)

    def settle(self, last: bool) -> dict:
        flat = np.concatenate([ids[placed:] for _, ids, placed in self.docs])
        doc_ends = np.cumsum([len(ids) - placed for _, ids, placed in self.docs])
        marks = np.zeros(len(flat) + 1, bool)
        marks[1:] = self.ends[flat]
        marks[doc_ends] = True
        marks[0] = True
        pos = np.flatnonzero(marks)
        wide = np.flatnonzero(np.diff(pos) > LONG_SENTENCE)
        inner = [np.arange(pos[k] + LONG_SENTENCE, pos[k + 1], LONG_SENTENCE) for k in wide]
        pos = np.sort(np.concatenate([pos, *inner]))
        penalty = np.where(marks[pos], SENTENCE_PENALTY, INNER_PENALTY)
        penalty[np.isin(pos, doc_ends)] = 0
        cuts = pos[choose_cuts(pos.tolist(), penalty.tolist(), self.window)]
        if not last:
            cuts = cuts[:-1]
        done = int(cuts[-1]) if len(cuts) else 0
        edges = np.unique(np.concatenate([[0], cuts, doc_ends[doc_ends < done]]))
        begin, end = edges[:-1], edges[1:]
        doc = np.searchsorted(doc_ends, begin, "right")
        sequence = np.searchsorted(cuts, begin, "right")
        doc_begin = np.concatenate([[0], doc_ends[:-1]])[doc]
        placed = np.array([p for _, _, p in self.docs], np.int64)[doc]
        out = {
            "doc_id": [self.docs[d][0] for d in doc], "start": begin - doc_begin + placed, "length": end - begin,
            "doc_tokens": np.array([len(self.docs[d][1]) for d in doc], np.int64),
            "sequence_id": self.sequence + sequence,
            "offset": begin - np.concatenate([[0], cuts])[sequence],
            "tokens": [flat[a:b].tobytes() for a, b in zip(begin, end)],
        }
        self.sequence += len(cuts)
        gone = int(np.searchsorted(doc_ends, done, "right"))
        rest = self.docs[gone:]
        if rest:
            already = done - (int(doc_ends[gone - 1]) if gone else 0)
            doc_id, ids, placed_before = rest[0]
            rest[0] = (doc_id, ids, placed_before + already)
        self.docs, self.held = rest, len(flat) - done
        return out


SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tokens binary")
ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")]
                  + [("tokens", pa.binary())])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         horizon: int = HORIZON, order: list[str] | None = None) -> DataFrame:
    """Pieces of packed documents: doc_id, start, length, doc_tokens, sequence_id, offset, tokens.

    ``tokens`` holds the piece's ids as little-endian unsigned 32-bit numbers. Each
    input partition is packed by itself in the order of its rows; only its last
    window is left part empty, and nothing is shuffled. ``order`` deals rows out by
    ranges of these columns first, where the stored order is not the wanted one.
    Null text is empty text and gives the end token alone; repeated rows are packed
    each by itself; empty tables give no rows. ``sequence_id`` is unique, not gapless.
    """
    spark = docs.sparkSession
    if order:
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = load_encoder(tokenizer_path, shared)
        packer = Packer(ends, window, horizon, TaskContext.get().partitionId() << 40)
        end = np.array([END_ID], "<u4")
        for part in (p for batch in batches for p in slices(batch, "text", RUN)):
            for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1))):
                for piece in packer.add(doc_id, np.concatenate([ids, end])):
                    yield pa.RecordBatch.from_pydict(piece, schema=ARROW)
        if packer.docs:
            yield pa.RecordBatch.from_pydict(packer.settle(True), schema=ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, SCHEMA)


def op1_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

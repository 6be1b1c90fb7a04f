"""SentencePiece models run by the tokenizers library.

The model file is parsed here; from it a tokenizer is rebuilt with the model's
normaliser, the metaspace marker, its unigram scores or its merges, and byte
fallback. Batches are encoded by the library's threads, and every chunk is compared
with the original library the first time it is seen.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import ChunkCache, documents, slices

MARK = "▁"
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: A run of markers with what follows it, up to the next run.
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Threads of the library in each Python worker; Spark runs a worker per core.
THREADS = 2
_LOADED: dict = {}


def wire(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: integers, 4- and 8-byte strings, byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"wire type {kind} is not known")
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at:at + size]
        at += size


@dataclass
class PieceModel:
    """The parts of a SentencePiece model file that encoding needs."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    single_spaces: bool = True
    mark_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in wire(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in wire(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                model.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in wire(value):
                    if n == 3:
                        model.kind = v
                    elif n == 35:
                        model.byte_fallback = bool(v)
            elif number == 3:
                for n, v in wire(value):
                    if n == 2:
                        model.charsmap = v
                    elif n == 3:
                        model.dummy_prefix = bool(v)
                    elif n == 4:
                        model.single_spaces = bool(v)
                    elif n == 5:
                        model.mark_spaces = bool(v)
        return model

    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def chunked(self) -> bool:
        """Whether no piece has a marker after another character, so texts may be cut before each run of markers."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))


def merges(model: PieceModel) -> list[tuple[str, str]]:
    """Every way to join two pieces to a third, best score first: the order in which the model joins."""
    scores = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
    found = [(-s, i, k, p[:k], p[k:]) for i, (p, s, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)
             for k in range(1, len(p)) if p[:k] in scores and p[k:] in scores]
    return [(a, b) for *_, a, b in sorted(found)]


def rebuild(model: PieceModel, normalised: bool = False):
    """A tokenizers Tokenizer that encodes and decodes like ``model``.

    ``normalised`` leaves out normaliser and split, for chunks that have been through both.
    """
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = model.unknown()
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model),
                          unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    tokenizer = Tokenizer(core)
    tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER])
    if normalised:
        return tokenizer
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.single_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.mark_spaces else " "))
    if model.mark_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if model.chunked():
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(CHUNK.pattern), "isolated")
    ends = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return tokenizer


class PieceCodec:
    """Encodes and decodes texts with one model; counts chunks on which the libraries differ."""

    def __init__(self, content: bytes, limit: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        import sentencepiece

        self.model = PieceModel.parse(content)
        self.tokenizer = rebuild(self.model)
        #: Only spaces change in this model's normal form.
        self.plain = not self.model.charsmap and not self.model.single_spaces
        self.chunked = self.model.chunked() and self.model.dummy_prefix and self.model.mark_spaces
        self.bare = rebuild(self.model, True)
        lead = 1 if self.model.dummy_prefix else 0
        self.lead = MARK.encode() * lead
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.encode() for p, _, kind in self.model.pieces]
        self.original = sentencepiece.SentencePieceProcessor()
        self.original.LoadFromSerializedProto(content)
        self.differing: set[str] = set()
        self.cache = ChunkCache(self._encode_chunks, limit)

    def _encode_chunks(self, tails: list[str]) -> Iterator[bytes]:
        """Ids of normalised chunks, given without their first marker; notes those on which the original library differs."""
        ours = [e.ids for e in self.bare.encode_batch_fast([MARK + t for t in tails], add_special_tokens=False)]
        # The original puts a marker in front by itself, but not before an empty text.
        theirs = self.original.encode([t.replace(MARK, " ") for t in tails], num_threads=1)
        lone = [self.original.piece_to_id(MARK)]
        self.differing.update(t for t, a, b in zip(tails, ours, theirs) if a != (b if t else lone))
        return (array("I", a).tobytes() for a in ours)

    def _tails(self, text: str) -> list[str] | None:
        """The chunks of a text without their first markers; None where a chunk has none."""
        if self.plain and "  " not in text and MARK not in text and text[:1] != " ":
            return text.split(" ") if text else []
        chunks = CHUNK.findall(self.tokenizer.normalizer.normalize_str(text))
        return None if chunks and chunks[0][0] != MARK else [c[1:] for c in chunks]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids of each text, packed, and whether they agree with the original library's."""
        if not self.chunked:
            theirs = self.original.encode(texts, num_threads=1)
            ours = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return [(array("I", a).tobytes(), a == b) for a, b in zip(ours, theirs)]
        out = []
        for group in self._groups(texts):
            cut = [self._tails(t) for t in group]
            # One call for the unknown chunks of many texts, which the library's threads share.
            known = self.cache.results({t for tails in cut for t in tails or ()})
            for text, tails in zip(group, cut):
                if tails is None:
                    # No marker in front: not cut as the original would see it, so encoded whole.
                    ours = self.tokenizer.encode(text, add_special_tokens=False).ids
                    out.append((array("I", ours).tobytes(), ours == self.original.encode(text)))
                    continue
                out.append((b"".join(map(known.__getitem__, tails)), self.differing.isdisjoint(tails)))
        return out

    @staticmethod
    def _groups(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
        """The texts in runs of about so many characters, so that a run's chunks stay few."""
        run, held = [], 0
        for text in texts:
            run.append(text)
            held += len(text)
            if held >= chars:
                yield run
                run, held = [], 0
        if run:
            yield run

    def decode(self, packed: list[bytes]) -> list[str]:
        """Texts of the ids; where their bytes are no whole characters, as the library's decoder has it."""
        out = []
        for one in (np.frombuffer(p, "<u4").tolist() for p in packed):
            data = b"".join(map(self.bytes.__getitem__, one))
            try:
                out.append(data.removeprefix(self.lead).decode().replace(MARK, " "))
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(one, skip_special_tokens=False))
        return out


def codec(path: str, content) -> PieceCodec:
    if path not in _LOADED:
        _LOADED[path] = PieceCodec(content.value)
    return _LOADED[path]


def _content(spark: SparkSession, path: str):
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None,
           round_trip: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit numbers), ``n_ids`` and ``parity``.

    ``parity`` is true where the original library gives the same ids; each distinct
    chunk is compared when it is first met. With ``round_trip`` a column of that name
    says whether decoding gives the text back. ``keep`` names the columns to pass on,
    all by default. Null text is empty text and has no ids. Rows are independent; no
    shuffle. Batches are encoded by the library's threads.
    """
    content = _content(docs.sparkSession, model_path)
    kept = docs.columns if keep is None else keep
    kinds = [("ids", T.BinaryType()), ("n_ids", T.LongType()), ("parity", T.BooleanType())]
    kinds += [("round_trip", T.BooleanType())] if round_trip else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, content)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [t or "" for t in part.column(part.schema.names.index(text_col)).to_pylist()]
                found = own.encode(texts)
                out = [pa.array([i for i, _ in found], pa.binary()), pa.array([len(i) // 4 for i, _ in found], pa.int64()),
                       pa.array([p for _, p in found], pa.bool_())]
                if round_trip:
                    out.append(pa.array([a == b for a, b in zip(own.decode([i for i, _ in found]), texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.names.index(c)) for c in kept), *out],
                                                 [*kept, *(n for n, _ in kinds)])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, k) for n, k in kinds)]))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids. Null ids give an empty text."""
    content = _content(rows.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, content)
        for batch in batches:
            for part in slices(batch, ids_col):
                ids = [i or b"" for i in part.column(part.schema.names.index(ids_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.decode(ids), pa.string())],
                                                 [*part.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, compared with the original library, decoded and compared with the text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return encode(texts, path, keep=["doc_id"], round_trip=True).select(
        "doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), "parity", "round_trip")

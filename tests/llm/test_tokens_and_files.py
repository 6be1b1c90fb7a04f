"""Packing, WARC bundles, chat trees, edit counts and the piece codec: round trips and brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlens import session
from marketlens.llm import chat, edit_counts, packing, piece_codec, warc
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "\x1c a\x1fb\x85c d", "<|endoftext|> İSTANBUL Σας ﬁ é", "x" * 30_000, "a. " * 9000, "don't stop!\n\n", "😀 ́"]


def library(path):
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def test_word_ids_are_those_of_the_plain_call():
    """Chunks put together from pieces give the ids of whole texts, control strings included."""
    tokenizer = Tokenizer.from_file(WORDS)
    encode, rng = packing.WordEncoder(tokenizer, limit=500), random.Random(1)
    letters = "aAzZéÉßİıΣσςǅ'\"-.,!?<|>1٣½² \t\n\x1c\x85\u2028  ≠\u0338\u0301’…$#_`ÿŸſK"
    odd = ["<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "don't", "'S", "'tis", "it's,", "x'll."]
    texts = ["".join(rng.choice(letters) if rng.random() < 0.85 else rng.choice(odd) for _ in range(rng.randint(0, 30)))
             for _ in range(20_000)] + ODD
    for text, ids in zip(texts, encode(texts)):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def check_packing(rows, texts, window):
    """Every id in one piece, sequences gapless and within the window; the share of padding."""
    tokenizer = Tokenizer.from_file(WORDS)
    want = collections.Counter()
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want[(doc_id, ids.tobytes())] += 1
    got, held = collections.Counter(), collections.defaultdict(bytes)
    sequences = collections.defaultdict(list)
    for r in rows:
        assert len(r.tokens) == 4 * r.length > 0
        sequences[r.sequence_id].append(r)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        key = r.doc_id
        assert r.start * 4 == len(held[key])
        held[key] += bytes(r.tokens)
        if len(held[key]) == 4 * r.doc_tokens:
            got[(key, held.pop(key))] += 1
    assert not held and got == want
    used = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *[p.length for p in pieces[:-1]]]).tolist()
        used += sum(p.length for p in pieces)
        assert sum(p.length for p in pieces) <= window
    return 1 - used / (window * len(sequences)) if sequences else 0


def test_packing(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in df.collect()]
    rows = packing.pack(df, WORDS).collect()
    assert check_packing(rows, texts, 4096) < 0.03
    # Pieces keep the order of rows, also over settled horizons and small windows.
    small = packing.pack(df.coalesce(1), WORDS, window=700, horizon=5000).collect()
    assert check_packing(small, texts, 700) < 0.1
    order = [r.doc_id for r in sorted(small, key=lambda r: (r.sequence_id, r.offset))]
    assert list(dict.fromkeys(order)) == [d for d, _ in texts]


def test_packing_awkward(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("tokens", F.lit(1))
    check_packing([r for r in packing.pack(df.filter("text <> 'same id' OR text IS NULL").coalesce(1), WORDS).collect()],
                  rows[:-1], 4096)
    assert packing.pack(df, WORDS, order=["doc_id"]).filter("doc_id = 3").count() >= 2
    assert packing.pack(df.limit(0), WORDS).count() == 0


def brute_cost(pos, penalty, window):
    best = [0.0] + [float("inf")] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            if pos[j] - pos[i] <= window:
                best[j] = min(best[j], best[i] + window - (pos[j] - pos[i]) + penalty[j])
    return best[-1]


def test_cuts_are_optimal():
    rng = random.Random(1)
    for _ in range(300):
        window = rng.choice([5, 20, 100])
        pos = [0]
        for _ in range(rng.randint(1, 40)):
            pos.append(pos[-1] + rng.randint(1, window))
        penalty = [0] + [rng.choice([0, 3, 30]) for _ in pos[1:]]
        cuts = packing.choose_cuts(pos, penalty, window)
        cost, last = 0, 0
        for c in cuts:
            assert pos[c] - pos[last] <= window
            cost += window - (pos[c] - pos[last]) + penalty[c]
            last = c
        assert cuts[-1] == len(pos) - 1 and cost == brute_cost(pos, penalty, window)


def test_warc_round_trip(spark):
    big = "<p>" + "long page " * 60_000
    rows = [(5, "http://a/\r\nX: 1", "copy " * 40), (3, "http://b", "copy " * 40), (9, None, "copy " * 40), (3, "http://b", "copy " * 40),
            (None, "http://n", "copy " * 40), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", big),
            (8, "u", "é\r\n\r\nWARC/1.1\r\n" * 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("key", F.lit(2))
    index = warc.write_bundles(df, session.scratch_dir(spark, "warc"), frame_bytes=1000)
    for read in (warc.read_bundles(index), warc.fetch(index)):
        got = collections.Counter()
        for r in read.collect():
            if r.payload is not None:
                assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
            got[(r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes)] += 1
        want = collections.Counter()
        for page, _, html in rows:
            data = (html or "").encode()
            revisit = html == "copy " * 40 and page in (5, 9)
            want[(page, "revisit" if revisit else "response", 3 if revisit else None, hashlib.sha256(data).hexdigest(), len(data))] += 1
        assert got == want
    one = warc.fetch(index.filter("page_id = 7")).collect()
    assert len(one) == 1 and one[0].payload.decode() == big
    # Any Zstandard reader takes a bundle: frames one after another, and a last frame that it skips.
    bundle = index.first().bundle
    store, path = pafs.FileSystem.from_uri(bundle)
    with store.open_input_file(path) as file:
        plain = zstandard.ZstdDecompressor().stream_reader(file.read(), read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\n") and len(list(warc.parse_records(plain))) == index.filter(F.col("bundle") == bundle).count()
    assert warc.write_bundles(df.limit(0), session.scratch_dir(spark, "warc")).count() == 0


TALKS = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 0, "system", "be kind"), (2, 1, "user", "hi"),
         (2, 2, "assistant", "hello"), (3, 0, "system", "be kind"), (3, 1, "user", "bye"), (4, 5, None, None), (4, 4, "assistant", ""),
         (4, 3, "a:b\n### x", "\\### Assistant: </turn> ok\\"), (None, 0, "user", "no id"), (None, 1, "assistant", "</turn>\n### user:\n####"),
         (5, 0, "user", "x"), (5, 0, "assistant", "same turn"), (5, None, "user", "null turn")]
TALKS += [(6, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(90)]
TALKS += [(7, k, "assistant" if k % 2 else "user", f"turn {k}" if k < 60 else "other") for k in range(70)]


def talk_digests(rows):
    talks = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in talks.items():
        turns.sort()
        answers = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(answers),
                     hashlib.sha256(answers.encode()).hexdigest(),
                     sum(len("".join(chat.format_turn(r, t))) for *_, r, t in turns))
    return out


@pytest.mark.parametrize("path", [None, BYTES])
@pytest.mark.parametrize("size", [chat.TREE_TOKENS, 40])
def test_chat_trees(spark, monkeypatch, path, size):
    monkeypatch.setattr(chat, "TREE_TOKENS", size)
    df = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1)).withColumn(
        "tree_id", F.lit(2))
    made = chat.trees(df, path)
    rows = made.collect()
    back = {r.conv_id: tuple(r)[1:] for r in chat.read_trees(made, path).collect()}
    assert back == talk_digests(TALKS)
    nodes = [r for r in rows if not r.is_end]
    if size > 40:
        # Equal beginnings stand once; past the shared turns each conversation has its own.
        texts = {(r.role or "", r.text or "") for r in df.filter("conv_id IN (1, 2, 3)").collect()}
        assert sum(n.depth < 3 for n in nodes) >= len(texts)
        assert len(nodes) == len(TALKS) - 3 - 1 - chat.SHARED_TURNS
    for n in nodes:
        assert n.position == sum(a.end - a.start for a in n.ancestors) and all(a.end <= n.start for a in n.ancestors)
    assert chat.read_trees(chat.trees(df.limit(0), path), path).count() == 0


def test_escapes_are_reversible():
    rng = random.Random(3)
    for _ in range(3000):
        role, text = ("".join(rng.choice(["\\", "#", "###", "</turn>", "\n", ":", "a", "### user:\n", "<", "</"]) for _ in range(rng.randint(0, 8)))
                      for _ in range(2))
        whole = "".join(chat.format_turn(role, text))
        assert chat.parse_turn(whole) == (role, text)
        assert [m[0] for m in chat.TURN.finditer(whole * 3)] == [whole] * 3


def test_edit_counts_fuzz():
    count = edit_counts.PieceCounter(open(BYTES, encoding="utf-8").read())
    full = library(BYTES)
    rng = random.Random(5)
    parts = ["a", "bc", "'s", " ", "  ", "\n", "\n\n", "1", "23", "!", "é", "word", "-", "\t", "'re", "x y", "😀"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 40, 900])))
        tree = edit_counts.CountTree.of(text, count)
        for _ in range(4):
            put = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 200])))
            text, _ = tree.edit(text, rng.randrange(-2, len(text) + 5), rng.choice([0, 0, 1, 3, 50, 400]), put, count)
            assert tree.total() == len(full.encode(text, add_special_tokens=False).ids) and tree.chars[1] == len(text)


def test_edit_counts_query(spark):
    full = library(BYTES)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    saved = 0
    for r in edit_counts.op9_edit_counts(spark, SF).collect():
        text = docs[r.doc_id]
        n = len(text)
        assert r.tokens_before == len(full.encode(text, add_special_tokens=False).ids)
        for at, cut, put in ((n // 3, 17, text[:40]), (2 * n // 3, 25, ""), (n + 100, 0, "\n\n  " + text[-30:])):
            at = min(at, len(text))
            text = text[:at] + put + text[at + cut:]
        assert (r.tokens_after, r.chars_after) == (len(full.encode(text, add_special_tokens=False).ids), len(text))
        saved += r.reencoded_chars < len(text)
    assert saved > len(docs) / 2


def test_edits_from_a_table(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "left alone"), (1, "again")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 3, "six"), (1, 1, 3, 0, " and"), (2, 1, 9, None, "new"), (8, 1, 0, 0, "x")],
                                  "doc_id long, seq long, at long, cut long, put string")
    rows = edit_counts.apply_edits(edit_counts.count_trees(edit_counts.with_edits(docs, edits), BYTES), BYTES).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, "six and two three"), (1, "six andin"), (2, "new"), (3, "left alone")]
    assert all(r.tokens_after == len(library(BYTES).encode(r.text, add_special_tokens=False).ids) for r in rows)


def test_piece_codec_agrees_with_the_library():
    codec = piece_codec.PieceCodec(open(PIECES, "rb").read())
    original = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(6)
    parts = ["a", "bc", " ", "  ", "\n", "1", "!", "é", "word", "\t", "x y", "😀", "▁", "   ", "\x00", "<s>", "ﬁ", "aaaa", "////"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 20]))) for _ in range(3000)] + [t or "" for t in ODD]
    found = codec.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i, _ in found] == original.encode(texts)
    assert all(same for _, same in found)
    assert codec.decode([i for i, _ in found]) == original.decode(original.encode(texts))


def test_piece_codec_unigram(tmp_path):
    """A unigram model with byte fallback, put together by hand, against the library."""
    def field(number, value):
        if isinstance(value, bytes):
            return bytes([number << 3 | 2]) + bytes([len(value)]) + value if number < 16 else bytes(
                [(number << 3 | 2) & 127 | 128, number >> 4, len(value)]) + value
        return (bytes([number << 3]) if number < 16 else bytes([(number << 3) & 127 | 128, number >> 4])) + bytes([value])

    import struct

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("▁ab", -1.5, 1), ("a", -4.0, 1), ("b", -4.1, 1), ("ab", -2.2, 1), ("bc", -2.5, 1), ("c", -4.2, 1), ("▁abc", -3.9, 1)]
    data = b"".join(field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    codec = piece_codec.PieceCodec(data)
    assert codec.model.kind == piece_codec.UNIGRAM and codec.model.byte_fallback
    original = sentencepiece.SentencePieceProcessor()
    original.LoadFromSerializedProto(data)
    texts = ["abc ab", "cab  bcé", "", "aabbcc abcabc", "zq ab"]
    assert [np.frombuffer(i, "<u4").tolist() for i, _ in codec.encode(texts)] == original.encode(texts)
    assert codec.decode([i for i, _ in codec.encode(texts)]) == texts


def test_piece_codec_frames(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = piece_codec.decode(piece_codec.encode(df, PIECES), PIECES).collect()
    assert all(r.parity and r.decoded == (r.text or "") and r.n_ids * 4 == len(r.ids) for r in out)
    assert piece_codec.encode(df.limit(0), PIECES).count() == 0


@pytest.mark.parametrize("name", ["op4_warc_bundles", "op5_chat_trees"])
def test_sql_forms(spark, name):
    from marketlens.llm import queries

    assert compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLES[name]) is None


def test_packing_digests(spark):
    row = packing.op1_pack_windows(spark, SF).filter("start = 0 AND length = doc_tokens").orderBy("doc_id").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("doc_id") == row.doc_id).first().text
    ids = np.array(library(WORDS).encode(text, add_special_tokens=False).ids + [2], "<u4")
    assert row.ids_crc32 == zlib.crc32(ids.tobytes())


def test_bundles_are_read_by_bytes(spark, monkeypatch):
    """The tasks that read frames grow with the frames' bytes, not with the few bytes of their rows."""
    rng = np.random.default_rng(1)
    pages = spark.createDataFrame([(i, f"u{i}", rng.bytes(300).hex()) for i in range(200)], "page_id long, url string, html string")
    index = warc.write_bundles(pages, session.scratch_dir(spark, "t-warc-bytes"), frame_bytes=2000)
    monkeypatch.setattr(warc, "TASK_BYTES", 5000)
    for found in (warc.read_bundles(index), warc.fetch(index)):
        assert found.rdd.getNumPartitions() > 5 and found.count() == 200

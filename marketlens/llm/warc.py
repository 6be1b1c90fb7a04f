"""WARC bundles in seekable Zstandard form.

A bundle is a run of independent Zstandard frames, each with whole records, and a
skippable last frame with the seek table: compressed and plain size of every frame.
An index maps each record to its frame and its place in the plain frame, so one
record costs one ranged read and one frame.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import session
from marketlens.llm.common import documents, saved, whole

#: Fixed values of the seekable format: skippable frame magic, table magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, LEVEL = 1 << 18, 3
#: Compressed bytes of frames that one task reads back.
TASK_BYTES = 4_000_000
#: Smaller payloads are always stored.
MIN_SHARED = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_id string, bundle string, frame int, frame_start long, frame_bytes long, start long, length long"
RECORD = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
          "payload binary")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if name in ("", "null") else int(name)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                  revisit: bool) -> bytes:
    """One record. Control characters of the url are percent-encoded, as header lines can't hold them."""
    target = "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {name.lower(): value.strip() for name, _, value in pairs}


def parse_records(data: bytes) -> Iterator[tuple]:
    """The records of one plain frame, as rows of ``RECORD``; a revisit has no payload of its own."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        head = _fields(data[at:head_end])
        block = data[head_end + 4:head_end + 4 + int(head["content-length"])]
        at = head_end + 4 + len(block) + 4
        http_end = block.index(b"\r\n\r\n")
        revisit = head["warc-type"] == "revisit"
        yield (_page_of(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"],
               head["warc-payload-digest"].removeprefix("sha256:"), int(_fields(block[:http_end])["content-length"]),
               _page_of(head.get("warc-refers-to")), None if revisit else block[http_end + 4:])


class BundleWriter:
    """Writes one bundle to a stream, frame by frame."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.frames: list[tuple[int, int]] = []
        self.waiting: list[tuple] = []
        self.plain, self.at = bytearray(), 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, page_id: int | None, record: bytes) -> list[tuple]:
        """Index rows of the frame that this record fills, if it does."""
        self.waiting.append((page_id, len(self.plain), len(record)))
        self.plain += record
        return self.flush() if len(self.plain) >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.waiting:
            return []
        packed = self.packer.compress(bytes(self.plain))
        self.out.write(packed)
        rows = [(p, _urn(p), len(self.frames), self.at, len(packed), start, n) for p, start, n in self.waiting]
        self.frames.append((len(packed), len(self.plain)))
        self.at += len(packed)
        self.waiting, self.plain = [], bytearray()
        return rows

    def finish(self) -> None:
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(file) -> list[tuple[int, int]]:
    """(start, bytes) of every frame, from the last bytes of a bundle."""
    size = file.size()
    count, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    data = file.read_at(8 * count, size - 9 - 8 * count)
    out, at = [], 0
    for packed, _ in struct.iter_unpack("<II", data):
        out.append((at, packed))
        at += packed
    return out


def _kinds(pages: DataFrame) -> DataFrame:
    """``pages`` as page_id, url, payload, digest, refers_to, revisit.

    Payloads shared by several records are told apart by digest; groups that hold
    over 1/200 of all rows are broadcast, and their rows are then dealt out by page,
    so no task gets the copies of one page alone.
    """
    html = whole(F.col("html"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.cast("binary").alias("payload"))
    rows = base.withColumn("digest", F.sha2("payload", 256))
    shared = saved(
        rows.filter(F.octet_length("payload") >= MIN_SHARED).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "warc-shared")
    # At most 200 groups are that large among the shared rows, whatever the corpus.
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = shared.filter(F.col("n") * 200 > total).select("digest", F.col("first").alias("hot_first"))
    cold = shared.filter(F.col("n") * 200 <= total).select(F.col("digest").alias("key"), F.col("first").alias("cold_first"))
    alone = F.concat(F.lit("page "), F.xxhash64("page_id", "url").cast("string"))
    keyed = rows.join(F.broadcast(hot), "digest", "left").withColumn(
        "key", F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(alone))
    first = F.coalesce("hot_first", "cold_first")
    revisit = F.coalesce(F.col("page_id") != first, F.lit(False))
    return keyed.join(cold, "key", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, first).alias("refers_to"), revisit.alias("revisit"))


def write_bundles(pages: DataFrame, location: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) under ``location``; gives the index.

    Of equal payloads of at least 100 bytes the row with the smallest page_id is a
    response and the others revisit it; repeated rows of that page_id are responses
    too, and so are rows with a null page_id. Null html is an empty payload. Each
    task writes one bundle under a name of its own, and the index, committed by
    Spark, names only bundles of tasks that ended well: a task that is run again
    leaves at most a file that nothing refers to. ``location`` must be in a store
    that executors share and that Arrow can write (file, hdfs, s3, gs).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(location)
        task = TaskContext.get()
        name = f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        writer = None

        def indexed(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            cols.insert(2, [f"{location.rstrip('/')}/{name}"] * len(rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        for batch in batches:
            if writer is None and batch.num_rows:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{name}", compression=None)
                writer = BundleWriter(out, frame_bytes)
            for values in zip(*batch.columns):
                page_id, url, payload, digest, refers_to, revisit = (v.as_py() for v in values)
                if rows := writer.add(page_id, encode_record(page_id, url, payload, digest, refers_to, revisit)):
                    yield indexed(rows)
        if writer is not None:
            if rows := writer.flush():
                yield indexed(rows)
            writer.finish()
            out.close()

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in INDEX.split(", ")]
    return saved(_kinds(pages).mapInArrow(run, INDEX), "warc-index")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in RECORD.split(", ")]
    cols = list(zip(*found)) if found else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records of the bundles named in column ``bundle``, by their seek tables alone, frame by frame."""
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                store, path = pafs.FileSystem.from_uri(bundle)
                with store.open_input_file(path) as file:
                    table = seek_table(file)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bundle] * len(table)), pa.array([s for s, _ in table], pa.int64()),
                     pa.array([n for _, n in table], pa.int64())], ["bundle", "frame_start", "frame_bytes"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = pafs.FileSystem.from_uri(bundle)
                with store.open_input_file(path) as file:
                    yield _rows(list(parse_records(zstandard.decompress(file.read_at(size, start)))))

    # A bundle is named by every record of its index: taken once each.
    listed = saved(bundles.select("bundle").distinct().mapInArrow(
        frames, "bundle string, frame_start long, frame_bytes long"), "warc-frames")
    return listed.repartition(_parts(listed), "bundle", "frame_start").mapInArrow(records, RECORD)


def _parts(frames: DataFrame) -> int:
    """Tasks to read so many frames with: a row of a frame is small, so its bytes count, not those that are shuffled."""
    total = frames.agg(F.coalesce(F.sum("frame_bytes"), F.lit(0))).first()[0]
    return max(1, -(-total // TASK_BYTES))


def fetch(index: DataFrame) -> DataFrame:
    """The records of the given index rows; each frame is read once, and only frames that are asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, plain = None, b""
        for batch in batches:
            found = []
            for bundle, frame_start, size, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                if held != (bundle, frame_start):
                    store, path = pafs.FileSystem.from_uri(bundle)
                    with store.open_input_file(path) as file:
                        plain = zstandard.decompress(file.read_at(size, frame_start))
                    held = (bundle, frame_start)
                found += parse_records(plain[start:start + length])
            yield _rows(found)

    wanted = index.select("bundle", "frame_start", "frame_bytes", "start", "length")
    parts = _parts(wanted.select("bundle", "frame_start", "frame_bytes").distinct())
    dealt = wanted.repartition(parts, "bundle", "frame_start").sortWithinPartitions("bundle", "frame_start", "start")
    return dealt.mapInArrow(run, RECORD)


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to bundles and read back; response payloads are measured anew."""
    index = write_bundles(documents(spark, sf_dir, "pages"), session.scratch_dir(spark, "warc"))
    stored = F.col("payload").isNotNull()
    return read_bundles(index).select(
        "page_id", F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to")


ORACLE = """
WITH t AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM t),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

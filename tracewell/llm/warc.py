"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a seek table in a skippable frame at the end
(the public seekable format) locates them, and an index maps each record identifier to frame, offset in the
frame and length. Payload duplicates are written as revisit records (profile identical-payload-digest).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._shared import fresh_dir, make_dirs, open_filesystem, stage

FRAME_BYTES = 1 << 20
FILE_BYTES = 256 << 20
UNIT_BYTES = 16 << 20
LEVEL = 3
REVISIT_MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_KEY = "urn:x-record:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def render_record(key: str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None) -> bytes:
    """One record: a response with payload, or (payload None) a revisit of refers_to with the HTTP header alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    kind = "response" if payload is not None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_KEY}{quote(key, safe='')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}" if url else "WARC-Target-URI: about:blank",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if payload is None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_KEY}{quote(refers_to, safe='')}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """(headers with lower-case names, block, offset of the next record)."""
    stop = raw.index(b"\r\n\r\n", at)
    lines = raw[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not at a record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    end = stop + 4 + int(headers["content-length"])
    return headers, raw[stop + 4 : end], end + 4


def _key_of(uri: str) -> str:
    return unquote(uri.strip("<>")[len(_KEY) :])


def open_record(headers: dict, block: bytes) -> dict:
    """Fields of a record as read: key, url, record_type, payload, payload_bytes, payload_digest, refers_to. A response's payload is hashed again."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
    return {
        "key": _key_of(headers["warc-record-id"]), "url": headers["warc-target-uri"], "record_type": kind,
        "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest,
        "refers_to": _key_of(headers["warc-refers-to"]) if "warc-refers-to" in headers else None,
    }


class BundleWriter:
    """Groups records into frames and closes with the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.size = self.written = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset in the frame, length)."""
        if self.held and self.size + len(record) > self.frame_bytes:
            self._flush()
        place = (len(self.frames), self.size, len(record))
        self.held.append(record)
        self.size += len(record)
        return place

    def _flush(self) -> None:
        if self.held:
            packed = self.compressor.compress(b"".join(self.held))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        body = np.asarray(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


def read_seek_table(source, size: int) -> np.ndarray:
    """Rows (compressed offset, compressed size, decompressed size) of the frames."""
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table: cut short or not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    source.seek(size - 9 - n * width)
    table = np.frombuffer(source.read(n * width), "<u4").reshape(n, width // 4)[:, :2].astype(np.int64)
    return np.column_stack((np.cumsum(table[:, 0]) - table[:, 0], table)) if n else np.empty((0, 3), np.int64)


def read_frame(source, table: np.ndarray, frame: int) -> bytes:
    offset, packed, size = map(int, table[frame])
    source.seek(offset)
    return zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=max(1, size))


def mark_revisits(pages: DataFrame, min_bytes: int = REVISIT_MIN_BYTES) -> DataFrame:
    """key (string), url, payload (binary, null where the record is a revisit), size, sha1 (hex), refers_to (key of the response).

    Of records whose payloads of at least min_bytes are equal, those with the smallest id are responses, the others
    revisits. Rows that repeat that id are responses too; null ids come last among equals, and are responses where all are null.
    The smallest id per digest is aggregated before the shuffle and read back from a staged table, so the join of
    a hot digest is split by adaptive execution; payloads are shuffled once."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    firsts = stage(
        rows.filter(F.col("size") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1").select(F.col("sha1").alias("first_sha1"), "first_id"),
        "warc-firsts",
    )
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    marked = rows.join(firsts, F.col("sha1") == F.col("first_sha1"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return marked.select(
        key("page_id").alias("key"), "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "sha1",
        F.when(revisit, key("first_id")).alias("refers_to"),
    )


def write_archives(records: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes mark_revisits() rows as bundles below path. Returns the stored index: key, path, frame, offset, length.

    Names carry the attempt and the index holds committed attempts only. A task keeps one frame and its current
    record in memory and starts a new file at file_bytes. An empty table writes nothing."""
    make_dirs(records.sparkSession, path)
    index = pa.schema([("key", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_filesystem(path)
        number, writer, sink, name, places = TaskContext.get().partitionId(), None, None, "", []

        def finish():
            writer.close()
            sink.close()
            total = fs.get_file_info(f"{base}/{name}").size
            keys, spots = zip(*places, strict=True)
            frame, offset, length = (np.asarray(x, np.int64) for x in zip(*spots, strict=True))
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([f"{path}/{name}"] * n), pa.array(np.full(n, total)), pa.array(frame), pa.array(offset), pa.array(length)], schema=index)

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("key", "url", "payload", "size", "sha1", "refers_to")}
                if writer is None:
                    name = f"part-{number:06d}-{uuid.uuid4().hex}.warc.zst"
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                    writer, places = BundleWriter(sink, frame_bytes), []
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                places.append((row["key"], writer.add(render_record(row["key"], row["url"], row["payload"], row["size"], digest, row["refers_to"]))))
                if writer.written >= file_bytes:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return stage(records.mapInArrow(run, "key string, path string, bytes long, frame long, offset long, length long"), "warc-index")


def read_archives(index: DataFrame, unit_bytes: int = UNIT_BYTES, with_payload: bool = True) -> DataFrame:
    """All records of the archives in an index, by their seek tables: runs of frames of about unit_bytes (decompressed) are read in parallel."""
    spark = index.sparkSession
    ways = max(1, spark.sparkContext.defaultParallelism)

    def plan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, local = open_filesystem(row["path"])
                with fs.open_input_file(local) as source:
                    sizes = read_seek_table(source, row["bytes"])[:, 2]
                stops, out, lo = np.cumsum(sizes), [], 0
                while lo < len(stops):
                    done = int(stops[lo - 1]) if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(stops, done + unit_bytes, "right")))
                    out.append({"path": row["path"], "bytes": row["bytes"], "lo": lo, "hi": hi})
                    lo = hi
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))

    names = ["key", "url", "record_type", *["payload"] * with_payload, "payload_bytes", "payload_digest", "refers_to"]
    kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
    schema = pa.schema([(c, kinds.get(c, pa.string())) for c in names])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, local = open_filesystem(row["path"])
                with fs.open_input_file(local) as source:
                    table = read_seek_table(source, row["bytes"])
                    for frame in range(row["lo"], row["hi"]):
                        raw, at, out = read_frame(source, table, frame), 0, []
                        while at < len(raw):
                            headers, block, at = parse_record(raw, at)
                            out.append(open_record(headers, block))
                        yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in out], schema=schema)

    files = index.select("path", "bytes").distinct()
    units = files.repartition(ways).mapInArrow(plan, "path string, bytes long, lo long, hi long")
    ddl = ", ".join(f"{c} {'binary' if c == 'payload' else 'long' if c == 'payload_bytes' else 'string'}" for c in names)
    return units.repartition(4 * ways).mapInArrow(read, ddl)


def fetch(index: DataFrame, key: str) -> list[dict]:
    """The records with one identifier, each by one ranged read of its frame (a driver-side lookup)."""
    out = []
    for row in index.filter(F.col("key") == key).collect():
        fs, local = open_filesystem(row["path"])
        with fs.open_input_file(local) as source:
            raw = read_frame(source, read_seek_table(source, row["bytes"]), row["frame"])
        out.append(open_record(*parse_record(raw, row["offset"])[:2]))
    return out


def archive_pages(pages: DataFrame, min_bytes: int = REVISIT_MIN_BYTES) -> DataFrame:
    """Write pages(page_id, url, html) to bundles in the shared folder and read every record back (null html: empty payload)."""
    path = fresh_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(mark_revisits(pages, min_bytes), path), with_payload=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    back = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long")
    return read.select(back("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (hex)
"""

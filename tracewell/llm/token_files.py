"""Token-ID files: static range asymmetric numeral coding with shared frequency tables.

A dataset is a folder with one shared frequency table and files of independent blocks. A block holds
up to BLOCK symbols in interleaved lanes (symbol i belongs to lane i mod lanes) and is cut by
checkpoints into segments; a segment stores the lanes' states at its start, its words and a CRC, so any
segment decodes alone. The footer lists segments and documents; readers take ranges of documents, start
at the checkpoint before them and verify each segment's checksum.

File: MAGIC, segments, footer, <footer offset u64, footer length u64, footer crc u32>, MAGIC.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm._shared import HELD, discard, fresh_dir, make_dirs, open_filesystem, small_batches, stage, tidied
from tracewell.llm.words import BYTE_CODES, mix64, slice_bounds, text_bytes

MAGIC = b"TWRANS1\n"
TAIL = struct.Struct("<QQI")
LOW = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)
LANES = 1024
BLOCK = 1 << 20
CHECKPOINT_STEPS = 256
TOKENS_PER_FILE = 32_000_000
TOKENS_PER_UNIT = 4_000_000
END_ID = 0

# ---------------------------------------------------------------- tokenizing

#: White space beyond ASCII of the Unicode property.
_FAR_BLANKS = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Classes of bytes: 1 blanks, 2 letters, 3 marks (but the apostrophe, which starts contractions), 0 all else.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 1
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 2
_CLASS[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 3
#: Texts of about so many bytes are encoded together; a longer one goes to the library whole.
_SLICE_BYTES, _LONG_BYTES = 1_000_000, 4_000_000
#: Slots of the table of remembered chunks; chunks of more bytes than _HELD_BYTES are encoded each time.
_SLOTS, _HELD_BYTES = 1 << 21, 128
_tokenizers: dict[str, TextEncoder] = {}


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def chunk_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places where a chunk begins: text starts, blanks after anything else, ASCII marks after Latin letters."""
    kind = _CLASS[data]
    before = kind[:-1]
    blank, mark = (kind[1:] == 1) & (before != 1), kind[1:] == 3
    start = np.zeros(len(data) + 1, bool)
    start[1 : len(data)] = blank | (mark & (before == 2))
    high = np.flatnonzero((blank | mark) & (data[:-1] >= 0x80)) + 1
    if len(high):
        start[high[mark[high - 1]]] = False
        two = high[(high >= 2) & mark[high - 1]]
        lead, last = data[two - 2], data[two - 1]
        start[two[(lead == 0xC3) & (last != 0x97) & (last != 0xB7)]] = True
        one = high[blank[high - 1]]
        for far in _FAR_BLANKS:
            same = one >= len(far)
            for k, byte in enumerate(reversed(far), 1):
                same[same] = data[one[same] - k] == byte
            start[one[same]] = False
    start[rows] = True
    return np.flatnonzero(start[: len(data)])


class ChunkTable:
    """Open-addressed table from chunks to their ids, all in arrays, which costs about 50 bytes a chunk.

    Chunks are told apart by two independent 64-bit hashes, polynomials of different bases over different codes of bytes. Patterns of letters that
    bring two polynomials of one base together need hundreds of letters, so longer chunks than _HELD_BYTES are never looked up."""

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    CODES = (BYTE_CODES, mix64(BYTE_CODES ^ np.uint64(0x5851F42D4C957F2D)))

    def __init__(self, kind: np.dtype, slots: int):
        self.kind, self.slots = kind, slots
        self.clear()

    def clear(self) -> None:
        self.powers = [np.ones(1, np.uint64)] * 4
        self.checks = np.zeros(self.slots, np.uint64)
        self.keys, self.entry = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.start, self.length, self.entries = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0
        self.flat, self.used = np.zeros(1 << 18, self.kind), 0

    def full(self) -> bool:
        return self.entries > self.slots // 2 or self.used > 8 * self.slots

    def hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers[0]) <= len(data):
            self.powers = []
            for base in self.BASES:
                for factor in (base, pow(base, -1, 1 << 64)):
                    grown = np.full(len(data) + 1, factor, np.uint64)
                    grown[0] = 1
                    self.powers.append(np.cumprod(grown, dtype=np.uint64))
        out = []
        for codes, powers, inverse in zip(self.CODES, self.powers[::2], self.powers[1::2], strict=True):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(codes[data] * powers[: len(data)], out=total[1:])
            out.append(mix64((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        return np.where(out[0] == 0, np.uint64(1), out[0]), out[1]

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Entry of each chunk, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = (there == keys[left]) & (self.checks[slot] == checks[left])
            out[left[hit]] = self.entry[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) % self.slots
        return out

    def append(self, ids: list[bytes]) -> np.ndarray:
        """New entries that are not looked up."""
        raw = np.frombuffer(b"".join(ids), self.kind)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        more = self.entries + len(ids)
        while more > len(self.start):
            self.start, self.length = np.concatenate((self.start, self.start)), np.concatenate((self.length, self.length))
        while self.used + len(raw) > len(self.flat):
            self.flat = np.concatenate((self.flat, self.flat))
        self.flat[self.used : self.used + len(raw)] = raw
        self.start[self.entries : more], self.length[self.entries : more] = self.used + np.cumsum(lengths) - lengths, lengths
        new = np.arange(self.entries, more)
        self.entries, self.used = more, self.used + len(raw)
        return new

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: list[bytes]) -> None:
        """Distinct new chunks with their ids."""
        new = self.append(ids)
        left, slot = np.arange(len(keys)), (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[slot[take]], self.checks[slot[take]], self.entry[slot[take]] = keys[left[take]], checks[left[take]], new[left[take]]
            on = np.ones(len(left), bool)
            on[take] = False
            left, slot = left[on], slot[on]
            slot = np.where(self.keys[slot] != 0, (slot + 1) % self.slots, slot)


class TextEncoder:
    """Texts -> little-endian id bytes, each with the end id appended. Where pre-tokens cannot span what parts chunks, chunks are
    encoded once by the tokenizers library and remembered, which spares it the repeats of a corpus; the first text of
    each slice is also encoded whole and compared."""

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end = np.asarray([END_ID], self.kind).tobytes()
        pre = model.get("pre_tokenizer") or {}
        added = model.get("added_tokens", [])
        self.added = [t["content"] for t in added]
        plain = not any(t.get("lstrip") or t.get("rstrip") for t in added)
        self.by_chunk = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("normalizer") and plain
        self.table = ChunkTable(self.kind, _SLOTS) if self.by_chunk else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
        """(begin, end, ids as binary) for slices of a string column without nulls."""
        lengths = pc.binary_length(column.cast(pa.large_string())).to_pylist()
        for a, b in slice_bounds(lengths, _SLICE_BYTES):
            part = column.slice(a, b - a)
            # an added token's content is one token wherever it stands
            apart = self.by_chunk and max(lengths[a:b]) <= _LONG_BYTES and not any(pc.any(pc.match_substring(part, t)).as_py() for t in self.added)
            yield a, b, self._chunked(part) if apart else pa.array([x + self.end for x in self._whole(part.to_pylist())], pa.binary())

    def release(self) -> None:
        """Forgets all chunks."""
        if self.table is not None:
            self.table = ChunkTable(self.kind, 1 << 10)

    def _chunked(self, column: pa.Array) -> pa.Array:
        data, rows = text_bytes(column)
        if self.table.slots < _SLOTS:
            self.table = ChunkTable(self.kind, _SLOTS)
        table = self.table
        if table.full() or not table.entries:
            table.clear()
            table.append([self.end])  # entry 0
        some = rows[:-1][np.diff(rows) > 0]
        begin = chunk_starts(data, some) if len(data) else np.empty(0, np.int64)
        end = np.append(begin[1:], len(data)) if len(begin) else begin
        keys, checks = table.hashes(data, begin, end)
        entry = table.find(keys, checks)
        long = np.flatnonzero(end - begin > _HELD_BYTES)
        entry[long] = -1
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            raw = data.tobytes()
            encode = lambda at: [x for k in range(0, len(at), 4000) for x in self._whole([raw[begin[j] : end[j]].decode() for j in at[k : k + 4000].tolist()])]
            missing = np.setdiff1d(missing, long, assume_unique=True)
            order = missing[np.lexsort((checks[missing], keys[missing]))]
            at = order[np.concatenate(([True], (keys[order[1:]] != keys[order[:-1]]) | (checks[order[1:]] != checks[order[:-1]])))] if len(order) else order
            table.add(keys[at], checks[at], encode(at))
            entry[missing] = table.find(keys[missing], checks[missing])
            entry[long] = table.append(encode(long))
        entry = np.insert(entry, np.searchsorted(begin, rows[1:], "left"), 0)
        lengths = table.length[entry].astype(np.int64)
        stops = np.cumsum(lengths)
        ids = table.flat[np.repeat(table.start[entry] - stops + lengths, lengths) + np.arange(int(stops[-1]) if len(stops) else 0)]
        last = np.searchsorted(begin, rows[1:], "left") + np.arange(len(column))
        bounds = np.concatenate(([0], stops[last] * self.kind.itemsize)).astype(np.int32)
        out = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
        if len(column) and out[0].as_py() != self._whole([column[0].as_py()])[0] + self.end:
            raise ValueError("this tokenizer's pre-tokens span chunks: encode whole texts instead")
        return out


def text_encoder(path: str) -> TextEncoder:
    if path not in _tokenizers:
        _tokenizers[path] = TextEncoder(path)
    return _tokenizers[path]


def _forget_chunks() -> None:
    for encoder in _tokenizers.values():
        encoder.release()


HELD["chunks"] = _forget_chunks


def tokenize(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, text -> doc_id, ids (binary, end id appended), n_tokens; whole texts, null as empty."""
    where = tokenizer_path
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(where or default_tokenizer_path())
        for batch in batches:
            for a, b, ids in encoder.encode(batch.column("text").fill_null("")):
                lengths = pc.binary_length(ids).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), ids, pc.divide(lengths, encoder.kind.itemsize)], ["doc_id", "ids", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run, "chunks"), "doc_id long, ids binary, n_tokens long")


# ---------------------------------------------------------------- frequency table and coder


class FrequencyTable:
    """Frequencies scaled to a power of two; every symbol that occurs keeps at least one slot."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.freq, self.bits = freq.astype(np.uint64), bits
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    @classmethod
    def of_counts(cls, counts: np.ndarray, bits: int | None = None) -> FrequencyTable:
        counts = np.asarray(counts, np.float64)
        present = int((counts > 0).sum())
        bits = bits or max(12, int(np.ceil(np.log2(max(present, 1)))) + 2)
        size = 1 << bits
        if present > size:
            raise ValueError("more symbols than slots")
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts * size / max(counts.sum(), 1))), 0).astype(np.int64)
        if not present:
            freq = np.zeros(max(1, len(counts)), np.int64)
            freq[0] = size
        while (rest := size - int(freq.sum())) != 0:
            order = np.argsort(-freq, kind="stable")
            if rest > 0:
                freq[order[0]] += rest
            else:
                take = np.clip(freq[order] - 1, 0, -rest)
                cut = np.minimum(take, np.maximum(0, -rest - np.concatenate(([0], np.cumsum(take)[:-1]))))
                freq[order] -= cut
        return cls(freq, bits)

    def to_bytes(self) -> bytes:
        body = struct.pack("<II", self.bits, len(self.freq)) + self.freq.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, raw: bytes) -> FrequencyTable:
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("frequency table: checksum differs")
        bits, n = struct.unpack_from("<II", raw)
        return cls(np.frombuffer(raw, "<u4", n, 8), bits)


def encode_block(symbols: np.ndarray, table: FrequencyTable, lanes: int = LANES, steps_per_segment: int = CHECKPOINT_STEPS) -> list[tuple[int, int, bytes]]:
    """Segments (symbols, lanes, states and words) of one block, in decoding order."""
    n = len(symbols)
    lanes = max(1, min(lanes, n // 32))
    freq, start, bits = table.freq[symbols], table.start[symbols], np.uint64(table.bits)
    if n and not freq.all():
        raise ValueError("a symbol has no slot in the shared table")
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    limit = np.uint64(63 - table.bits)
    segments: list[tuple[int, int, bytes]] = []
    words: list[np.ndarray] = []
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: b - a], freq[a:b]
        over = x >= (f << limit)
        if over.any():
            full = x[over]
            words.append(full.astype("<u4"))
            x[over] = full >> WORD_BITS
        high = x // f
        x[:] = (high << bits) + (x - high * f) + start[a:b]
        if step % steps_per_segment == 0:
            last = min(n, (step + steps_per_segment) * lanes)
            segments.append((last - a, lanes, state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))))
            words = []
    return segments[::-1]


def decode_segment(n: int, lanes: int, raw: bytes, table: FrequencyTable) -> np.ndarray:
    """The n symbols of one segment."""
    state = np.frombuffer(raw, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(raw, "<u4", -1, 8 * lanes).astype(np.uint64)
    out = np.empty(n, np.uint32)
    bits, mask, at = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), 0
    for a in range(0, n, lanes):
        b = min(n, a + lanes)
        x = state[: b - a]
        slot = x & mask
        symbol = table.slots[slot]
        out[a:b] = symbol
        x[:] = table.freq[symbol] * (x >> bits) + slot - table.start[symbol]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << WORD_BITS) | words[at : at + len(low)]
            at += len(low)
    return out


# ---------------------------------------------------------------- files

_FOOTER = ("seg_offset <u8", "seg_bytes <u8", "seg_symbols <u4", "seg_lanes <u4", "seg_crc <u4", "seg_block <u4", "doc_id <i8", "doc_null <u1", "doc_length <u8")


class FileWriter:
    """Writes one file; documents may span blocks."""

    def __init__(self, sink, table: FrequencyTable):
        self.sink, self.table, self.at, self.block = sink, table, len(MAGIC), 0
        self.pending: list[np.ndarray] = []
        self.held = 0
        self.columns: dict[str, list[int]] = {c.split()[0]: [] for c in _FOOTER}
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.columns["doc_id"].append(doc_id or 0)
        self.columns["doc_null"].append(doc_id is None)
        self.columns["doc_length"].append(len(ids))
        while len(ids):
            part = ids[: BLOCK - self.held]
            self.pending.append(part)
            self.held += len(part)
            ids = ids[len(part) :]
            if self.held == BLOCK:
                self._flush()

    def _flush(self) -> None:
        if not self.held:
            return
        for n, lanes, raw in encode_block(np.concatenate(self.pending), self.table):
            for k, v in zip(("seg_offset", "seg_bytes", "seg_symbols", "seg_lanes", "seg_crc", "seg_block"), (self.at, len(raw), n, lanes, zlib.crc32(raw), self.block), strict=True):
                self.columns[k].append(v)
            self.sink.write(raw)
            self.at += len(raw)
        self.pending, self.held, self.block = [], 0, self.block + 1

    def close(self) -> None:
        self._flush()
        out = io.BytesIO()
        for c in _FOOTER:
            name, kind = c.split()
            body = np.asarray(self.columns[name], kind).tobytes()
            out.write(struct.pack("<Q", len(body)) + body)
        body = zlib.compress(out.getvalue(), 1)
        self.sink.write(body + TAIL.pack(self.at, len(body), zlib.crc32(body)) + MAGIC)


def read_footer(source, size: int) -> dict[str, np.ndarray]:
    source.seek(size - TAIL.size - len(MAGIC))
    tail = source.read(TAIL.size + len(MAGIC))
    if tail[TAIL.size :] != MAGIC:
        raise ValueError("not a token file, or cut short")
    offset, length, crc = TAIL.unpack(tail[: TAIL.size])
    source.seek(offset)
    body = source.read(length)
    if zlib.crc32(body) != crc:
        raise ValueError("footer: checksum differs")
    raw, at, out = zlib.decompress(body), 0, {}
    for c in _FOOTER:
        name, kind = c.split()
        (n,) = struct.unpack_from("<Q", raw, at)
        out[name] = np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8)
        at += 8 + n
    return out


def read_symbols(source, footer: dict[str, np.ndarray], table: FrequencyTable, begin: int, end: int) -> np.ndarray:
    """Symbols begin..end of a file: only the segments that hold them are read, verified and decoded."""
    stops = np.cumsum(footer["seg_symbols"].astype(np.int64))
    first, last = int(np.searchsorted(stops, begin, "right")), int(np.searchsorted(stops, end, "left"))
    parts = []
    for k in range(first, last + 1) if end > begin else ():
        source.seek(int(footer["seg_offset"][k]))
        raw = source.read(int(footer["seg_bytes"][k]))
        if zlib.crc32(raw) != footer["seg_crc"][k]:
            raise ValueError(f"segment {k}: checksum differs")
        parts.append(decode_segment(int(footer["seg_symbols"][k]), int(footer["seg_lanes"][k]), raw, table))
    if not parts:
        return np.empty(0, np.uint32)
    head = int(stops[first] - footer["seg_symbols"][first])
    return np.concatenate(parts)[begin - head : end - head]


# ---------------------------------------------------------------- Spark


def count_ids(tokens: DataFrame, wide: bool) -> np.ndarray:
    """Occurrences of every id over all documents; one row an id reaches the driver (bounded by the vocabulary)."""
    kind = "<u4" if wide else "<u2"

    def run(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            raw = b"".join(x for x in batch.column("ids").to_pylist() if x)
            part = np.bincount(np.frombuffer(raw, kind), minlength=len(total)).astype(np.int64)
            part[: len(total)] += total
            total = part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(tidied(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([END_ID, *(r["id"] for r in rows)]) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str | None = None, tokens_per_file: int = TOKENS_PER_FILE) -> DataFrame:
    """Encodes documents(doc_id, text) into token files below path, in ascending doc_id order (null ids first, repeated
    ids together, shorter first). Returns the manifest: file, path, bytes, n_docs, n_tokens, start. Null and
    empty texts hold the end id alone; an empty table gives no files and an empty manifest. A file's name
    carries its attempt, and the manifest lists only committed attempts, so lost executors leave no half files in it."""
    spark = docs.sparkSession
    make_dirs(spark, path)
    wide = text_encoder(tokenizer_path or default_tokenizer_path()).kind.itemsize == 4
    kind = "<u4" if wide else "<u2"
    tokens = stage(tokenize(docs, tokenizer_path), "ids")
    counts = count_ids(tokens, wide)
    table = FrequencyTable.of_counts(counts)
    fs, local = open_filesystem(path)
    with fs.open_output_stream(f"{local}/table.bin") as sink:
        sink.write(table.to_bytes())
    files = max(1, -(-int(counts.sum()) // tokens_per_file))

    def run(batches):
        fs_, base = open_filesystem(path)
        with fs_.open_input_stream(f"{base}/table.bin") as source:
            shared = FrequencyTable.from_bytes(source.read())
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex}.rans"
        writer = sink = None
        docs_, symbols = 0, 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if writer is None:
                    sink = fs_.open_output_stream(f"{base}/{name}")
                    writer = FileWriter(sink, shared)
                row = np.frombuffer(ids.as_buffer(), kind)
                writer.add(doc_id, row)
                docs_, symbols = docs_ + 1, symbols + len(row)
        if writer is not None:
            writer.close()
            sink.close()
            size = fs_.get_file_info(f"{base}/{name}").size
            yield pa.RecordBatch.from_pydict({"file": [number], "path": [f"{path}/{name}"], "bytes": [size], "n_docs": [docs_], "n_tokens": [symbols]}, schema=pa.schema([("file", pa.int64()), ("path", pa.string()), ("bytes", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = tokens.repartitionByRange(files, F.col("doc_id").asc()).sortWithinPartitions("doc_id", "n_tokens", F.crc32("ids"))
    written = stage(ordered.select("doc_id", "ids").mapInArrow(tidied(run), "file long, path string, bytes long, n_docs long, n_tokens long"), "token-manifest")
    discard(tokens)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return written.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_token_files(manifest: DataFrame, tokens_per_unit: int = TOKENS_PER_UNIT, with_ids: bool = False) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start, n_tokens, ids_crc32 (and ids as little-endian 32-bit binary).
    Files are cut into ranges of whole documents of about tokens_per_unit ids, decoded in parallel."""
    spark = manifest.sparkSession
    split = "path string, bytes long, lo long, hi long, begin long, end long, start long"

    def plan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, local = open_filesystem(row["path"])
                with fs.open_input_file(local) as source:
                    stops = np.cumsum(read_footer(source, row["bytes"])["doc_length"].astype(np.int64))
                out, lo = [], 0
                while lo < len(stops):
                    begin = int(stops[lo - 1]) if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(stops, begin + tokens_per_unit, "right")))
                    out.append({"path": row["path"], "bytes": row["bytes"], "lo": lo, "hi": hi, "begin": begin, "end": int(stops[hi - 1]), "start": row["start"]})
                    lo = hi
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in split.split(", ")]))

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, local = open_filesystem(row["path"])
                with fs.open_input_stream(f"{local.rpartition('/')[0]}/table.bin") as source:
                    table = FrequencyTable.from_bytes(source.read())
                with fs.open_input_file(local) as source:
                    footer = read_footer(source, row["bytes"])
                    ids = read_symbols(source, footer, table, row["begin"], row["end"]).astype("<u4")
                lengths = footer["doc_length"][row["lo"] : row["hi"]].astype(np.int64)
                stops = np.cumsum(lengths)
                pieces = [ids[b - n : b].tobytes() for b, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
                columns = [
                    pa.array(footer["doc_id"][row["lo"] : row["hi"]], pa.int64(), mask=footer["doc_null"][row["lo"] : row["hi"]].astype(bool)),
                    pa.array(row["start"] + row["begin"] + stops - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(pieces, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    ways = max(1, spark.sparkContext.defaultParallelism)
    units = manifest.select("path", "bytes", "start").repartition(ways).mapInArrow(plan, split)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return units.repartition(4 * ways).mapInArrow(tidied(decode), schema)


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None, tokens_per_file: int = TOKENS_PER_FILE) -> DataFrame:
    """Write documents to token files in the shared folder and read them back (one row a document)."""
    path = fresh_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, path, tokenizer_path, tokens_per_file))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

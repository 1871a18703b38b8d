"""Word hashing over whole Arrow batches: byte classes, word bounds and 64-bit hashes in numpy, no loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A word's hash sums its mixed bytes, each times a pseudo-random odd number of its place, and mixes the sum. Words are compared by these 64 bits: no
#: pattern of letters makes two words collide (powers of one base would have such patterns, of 1024 letters and more), chance does once in 2**64 pairs.
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Bytes hashed at a time, which bounds the memory of the temporaries.
SPAN = 2_000_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that hashes of similar inputs spread over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place_factors(n: int) -> np.ndarray:
    """A pseudo-random odd number of each place."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def alnum_words() -> np.ndarray:
    """Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z: digits, a-z and all that is not ASCII."""
    inside = np.zeros(256, bool)
    inside[0x30:0x3A] = inside[0x41:0x5B] = inside[0x61:0x7B] = inside[0x80:] = True
    return inside


def blank_words() -> np.ndarray:
    """Bytes of words [^\\x20\\x09-\\x0D]+."""
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return inside


def run_kinds() -> np.ndarray:
    """Kinds for runs: 0 blanks, 1 small and non-ASCII letters, 2 capitals, 3 digits, and each other ASCII byte its own."""
    kinds = np.arange(256) % 128 + 4
    kinds[[0x20, *range(0x09, 0x0E)]] = 0
    kinds[0x61:0x7B] = kinds[0x80:] = 1
    kinds[0x41:0x5B] = 2
    kinds[0x30:0x3A] = 3
    return kinds


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row bounds) of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(bounds):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, most: int = 4_000_000, text: str = "text"):
    """Runs of rows whose texts hold at most about `most` bytes (one row at least), which bounds a task's memory."""
    column = batch.column(text).cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def slice_bounds(sizes: list[int], most: int):
    """Runs of at least one item whose sizes sum to at most `most`."""
    begin = total = 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > most:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


class WordSplitter:
    """Lower-cases A-Z (unless told not to) and hashes the words of every text of a batch. A word is a maximal run of bytes
    of one kind; bytes of kind 0 part words."""

    def __init__(self, kinds: np.ndarray, lower: bool = True):
        self.kinds = kinds.astype(np.uint8)
        codes = BYTE_CODES.copy()
        if lower:
            codes[0x41:0x5B] = codes[0x61:0x7B]
        self.codes = codes
        self.powers = place_factors(64)

    def _factors(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            self.powers = place_factors(max(n, 64))
        return self.powers

    def _hash(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, start places) of the words within one piece; pieces end at row ends."""
        if not len(data):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        kind = self.kinds[data]
        turn = kind[1:] != kind[:-1]
        begin = np.flatnonzero(np.concatenate(([True], turn)) & (kind > 0))
        end = np.flatnonzero(np.concatenate((turn, [True])) & (kind > 0)) + 1
        return self._sum(data, begin, end), begin

    def _sum(self, data, begin, end):
        if not len(begin):
            return np.empty(0, np.uint64)
        lengths = end - begin
        starts = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(starts, lengths)
        values = self.codes[data[np.repeat(begin, lengths) + place]] * self._factors(int(lengths.max()))[place]
        return mix64(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes in order, bounds of each row's words)."""
        data, rows = text_bytes(column)
        n = len(rows) - 1
        hashes, counts = [], np.zeros(n, np.int64)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(rows, rows[a] + SPAN, "right")) - 1)
            piece = data[rows[a] : rows[b]]
            if b - a > 1:
                # rows are hashed together with a blank put between them, so no word crosses a row
                inner = rows[a + 1 : b] - rows[a]
                piece = np.insert(piece, inner, 0x20)
                stops = inner + np.arange(len(inner)) + 1
            else:
                stops = np.empty(0, np.int64)
            h, begin = self._hash(piece)
            hashes.append(h)
            counts[a:b] = np.diff(np.concatenate(([0], np.searchsorted(begin, stops), [len(begin)])))
            a = b
        return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))

"""Distinct 5-word shingles of whole texts as sorted 64-bit hashes, and the global token order of the similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tracewell.llm.words import WordSplitter, blank_words, mix64

SIZE = 5
_SPLIT = WordSplitter(blank_words())
_WEIGHTS = mix64(np.arange(101, 101 + SIZE, dtype=np.uint64)) | np.uint64(1)
_SHORT = mix64(np.arange(201, 201 + SIZE, dtype=np.uint64))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of every text of a column without nulls. Fewer than five words: the whole sequence as one; none: empty."""
    words, bounds = _SPLIT(column)
    n = len(words) - SIZE + 1
    if n > 0:
        keys = np.zeros(n, np.uint64)
        for k in range(SIZE):
            keys += words[k : k + n] * _WEIGHTS[k]
        keys = mix64(keys)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        count = b - a
        if count >= SIZE:
            row = np.sort(keys[a : b - SIZE + 1])
            yield row[np.concatenate(([True], row[1:] != row[:-1]))]
        elif count:
            yield mix64((words[a:b] * _WEIGHTS[:count]).sum(keepdims=True) + _SHORT[count])
        else:
            yield np.empty(0, np.uint64)


def fingerprints(row: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit fingerprints of a set."""
    if not len(row):
        return 0, 0
    one, two = mix64(row + np.uint64(17)).sum(), mix64(row ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
    pair = mix64(np.asarray([one + np.uint64(len(row)), two], np.uint64)).view(np.int64)
    return int(pair[0]), int(pair[1])

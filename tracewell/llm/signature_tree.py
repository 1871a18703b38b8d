"""Signature trees over sets that share a token: nodes hold OR-combined token bitmaps, size ranges and component ranges;
a dual traversal drops node pairs whose greatest possible overlap is too small, or that lie in one component already."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PERCENT = 75
LEAF = 16
FAN_OUT = 8
MIN_BITS, MAX_BITS = 64, 1 << 20


def least_overlap(a, b):
    """Shared tokens that sets of sizes a and b need for 100 * intersection >= 75 * union."""
    return -(-(a + b) * PERCENT // (100 + PERCENT))


def bitmap(row: np.ndarray) -> np.ndarray:
    """One bit a token, at about two to four bits a token."""
    bits = MIN_BITS
    while bits < 2 * len(row) and bits < MAX_BITS:
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(row & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view("<u8")


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """The bitmap of the same tokens at a smaller power-of-two width (in 64-bit words)."""
    while len(words) > width:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


class SignatureTree:
    """Bulk-loaded over members (size, position of the shared token, component, bitmap). exact says that bitmaps of equal width
    have one bit for each token that two members share, so that leaves give links, not candidates."""

    def __init__(self, sizes: np.ndarray, places: np.ndarray, parts: np.ndarray, bitmaps: list[np.ndarray], exact: bool = False):
        _, inverse, shared = np.unique(parts, return_inverse=True, return_counts=True)
        single = shared[inverse] == 1
        self.order = np.lexsort((sizes, np.where(single, 0, inverse), single))
        self.sizes, self.places, self.parts = sizes[self.order], places[self.order], parts[self.order]
        width = min(map(len, bitmaps))
        self.bits = np.stack([fold(bitmaps[k], width) for k in self.order])
        self.exact = exact
        self.slack = self.sizes * 0 if exact else self.sizes - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        begin = np.arange(0, len(sizes), LEAF)
        level = [self._node(b, min(len(sizes), b + LEAF), ()) for b in begin.tolist()]
        while len(level) > 1:
            level = [self._node(g[0][0], g[-1][1], g) for g in (level[k : k + FAN_OUT] for k in range(0, len(level), FAN_OUT))]
        self.root = level[0]

    def _node(self, a, b, children):
        if children:
            bits = np.bitwise_or.reduce([c[2] for c in children])
        else:
            bits = np.bitwise_or.reduce(self.bits[a:b], axis=0)
        part = self.parts[a:b]
        return a, b, bits, int(self.sizes[a:b].min()), int(self.sizes[a:b].max()), int(self.slack[a:b].max()), part.min(), part.max(), children

    def _apart(self, x, y) -> bool:
        """Whether no pair across the nodes needs to be looked at."""
        if x[6] == x[7] == y[6] == y[7]:
            return True
        if x[4] * 100 < y[3] * PERCENT or y[4] * 100 < x[3] * PERCENT:
            return True
        overlap = int(np.bitwise_count(x[2] & y[2]).sum()) + min(x[5], y[5])
        return min(overlap, x[4], y[4]) < least_overlap(x[3], y[3])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of member numbers (as given) in different components that may reach the similarity."""
        stack = [(self.root, self.root)]
        while stack:
            x, y = stack.pop()
            if self._apart(x, y):
                continue
            if x is y and x[8]:
                stack += [(c, d) for k, c in enumerate(x[8]) for d in x[8][k:]]
            elif x[8] or y[8]:
                if y[8] and (not x[8] or y[1] - y[0] > x[1] - x[0]):
                    x, y = y, x
                stack += [(c, y) for c in x[8]]
            else:
                i, j = np.meshgrid(np.arange(x[0], x[1]), np.arange(y[0], y[1]), indexing="ij")
                keep = i < j if x is y else np.ones(i.shape, bool)
                i, j = i[keep], j[keep]
                need = least_overlap(self.sizes[i], self.sizes[j])
                fit = (self.parts[i] != self.parts[j]) & (self.places[i] <= self.sizes[i] - need) & (self.places[j] <= self.sizes[j] - need)
                i, j, need = i[fit], j[fit], need[fit]
                if len(i):
                    a, b = self.bits[i], self.bits[j]
                    most = np.bitwise_count(a & b).sum(axis=1, dtype=np.int64) if self.exact else np.minimum(self.sizes[i] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), self.sizes[j] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
                    ok = most >= need
                    if ok.any():
                        yield self.order[i[ok]], self.order[j[ok]]


def shared_bitmaps(sets: list[np.ndarray], most_bytes: int = 1 << 26) -> np.ndarray | None:
    """One row a set with one bit for each token that two of them share; None if that takes more than most_bytes."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    width = max(1, -(-int(place[-1] + 1) // 64))
    if len(sets) * width * 8 > most_bytes:
        return None
    keep = counts[inverse] > 1
    at, row = place[inverse[keep]], owner[keep]
    out = np.zeros((len(sets), width), np.uint64)
    np.bitwise_or.at(out, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


class Merged:
    """Labels of members that are merged by pairs; a pair of one label already is left out."""

    def __init__(self, parts: np.ndarray):
        self.names, self.label = np.unique(parts, return_inverse=True)

    def feed(self, i: np.ndarray, j: np.ndarray, linked=None) -> Iterator[tuple[int, int]]:
        """The pairs that merge two labels, one after the other; linked(a, b) says whether a pair is a link at all."""
        label = self.label
        while True:
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if not len(i):
                return
            a, b = int(i[0]), int(j[0])
            i, j = i[1:], j[1:]
            if linked is None or linked(a, b):
                label[label == label[b]] = label[a]
                yield a, b


def merging_pairs(sizes: np.ndarray, places: np.ndarray, parts: np.ndarray, bitmaps: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of members that may reach the similarity, one for each merger of parts."""
    merged, out = Merged(parts), []
    widths = np.asarray(list(map(len, bitmaps)))
    for width in np.unique(widths).tolist():
        # sets that may be linked have bitmaps of one width, or one of twice the other; folding further would fill them
        at = np.flatnonzero((widths == width) | (widths == 2 * width))
        label = merged.label[at]
        if len(at) > 1 and label.min() != label.max():
            for i, j in SignatureTree(sizes[at], places[at], label, [bitmaps[k] for k in at]).pairs():
                i, j = at[i], at[j]
                here = (widths[i] == width) | (widths[j] == width)
                out += merged.feed(i[here], j[here])
    return out


def tree_links(sizes: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], strides: tuple[int, ...]) -> list[tuple[int, int]]:
    """Links (member numbers) that join the given parts as all links among these sets would; a link inside what is joined
    already is left out. Neighbours by size are tried first, so that the nodes of a group of near copies hold one part."""
    rows = shared_bitmaps(sets)
    merged, out = Merged(parts), []

    def linked(a, b):
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return 100 * both >= PERCENT * (len(sets[a]) + len(sets[b]) - both)

    test = None if rows is not None else linked
    order = np.argsort(sizes, kind="stable")
    for w in strides:
        i, j = order[:-w], order[w:]
        fit = least_overlap(sizes[i], sizes[j]) <= np.minimum(sizes[i], sizes[j])
        i, j = i[fit], j[fit]
        for k in range(0, len(i), 1024):
            x, y = i[k : k + 1024], j[k : k + 1024]
            if rows is not None:
                enough = np.bitwise_count(rows[x] & rows[y]).sum(axis=1, dtype=np.int64) >= least_overlap(sizes[x], sizes[y])
                x, y = x[enough], y[enough]
            out += merged.feed(x, y, test)
    if len(np.unique(merged.label)) > 1:
        bitmaps = list(rows) if rows is not None else [bitmap(s) for s in sets]
        for i, j in SignatureTree(sizes, sizes * 0, merged.label.copy(), bitmaps, exact=rows is not None).pairs():
            out += merged.feed(i, j, test)
    return out


def linked_weights(sizes: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """For each member the weights of all members of other parts that it links with, added up."""
    rows = shared_bitmaps(sets)
    total = np.zeros(len(sets), np.int64)
    bitmaps = list(rows) if rows is not None else [bitmap(s) for s in sets]
    for i, j in SignatureTree(sizes, sizes * 0, parts, bitmaps, exact=rows is not None).pairs():
        if rows is None:
            both = np.asarray([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
            ok = both >= least_overlap(sizes[i], sizes[j])
            i, j = i[ok], j[ok]
        np.add.at(total, i, weights[j])
        np.add.at(total, j, weights[i])
    return total


def may_reach(a: bytes, b: bytes, size_a: int, size_b: int) -> bool:
    """The bound of a leaf for one pair."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    width = min(len(x), len(y))
    x, y = fold(x, width), fold(y, width)
    need = least_overlap(size_a, size_b)
    return size_a - int(np.bitwise_count(x & ~y).sum()) >= need and size_b - int(np.bitwise_count(y & ~x).sum()) >= need

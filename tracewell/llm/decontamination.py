"""Benchmark decontamination over a distributed positional inverted index.

The index is document-partitioned: every task tokenizes its documents into shards and stores, per shard,
the sorted terms, their document positions and the document bounds. Search reads the index shard by
shard and test windows in blocks from the shared folder, so neither side has to fit a broadcast:
per window the shard's rarest terms come first, their offset-adjusted position lists are intersected,
and what is left are exact phrase (or, with slop, proximity) matches. No postings are shuffled, so a
frequent term or passage makes no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._shared import fresh_dir, open_filesystem, small_batches, stage, tidied
from tracewell.llm.words import WordSplitter, alnum_words, slices

WINDOW = 10
SHARD_TOKENS = 60_000
WINDOW_BLOCK = 50_000
#: Blocks of windows (about 5 MB each) that a task keeps.
HELD_BLOCKS = 16

_SPLIT = WordSplitter(alnum_words())


def build_index(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> stored index, one row a shard of whole documents: doc_ids, doc_null, bounds, terms, counts,
    positions (all binary). Every row of docs is indexed, null and empty texts as documents without postings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole)):
            hashes, bounds = _SPLIT(batch.column("text"))
            ids = batch.column("doc_id")
            a, n = 0, batch.num_rows
            while a < n:
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SHARD_TOKENS, "right")) - 1)
                words = hashes[bounds[a] : bounds[b]]
                order = np.argsort(words, kind="stable").astype("<u4")
                terms, counts = np.unique(words, return_counts=True)
                part = ids.slice(a, b - a)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_ids": [np.asarray(part.fill_null(0), "<i8").tobytes()],
                        "doc_null": [np.asarray(part.is_null(), "u1").tobytes()],
                        "bounds": [(bounds[a : b + 1] - bounds[a]).astype("<i8").tobytes()],
                        "terms": [terms.astype("<u8").tobytes()],
                        "counts": [counts.astype("<u4").tobytes()],
                        "positions": [order.tobytes()],
                    },
                    schema=pa.schema([(c, pa.binary()) for c in ("doc_ids", "doc_null", "bounds", "terms", "counts", "positions")]),
                )
                a = b

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stage(narrow.mapInArrow(tidied(run), "doc_ids binary, doc_null binary, bounds binary, terms binary, counts binary, positions binary"), "index")


def store_windows(items: DataFrame, window: int = WINDOW) -> str:
    """items(item_id, text) -> folder with their windows: item (string), length, terms (binary of 64-bit word hashes).
    An item of fewer words than the window is one window; without words, or with a null id, it has none."""

    def run(batches):
        for batch in (x for whole in batches for x in slices(whole)):
            hashes, bounds = _SPLIT(batch.column("text"))
            out = {"item": [], "terms": []}
            for k, item in enumerate(batch.column("item").to_pylist()):
                row = hashes[bounds[k] : bounds[k + 1]].astype("<u8")
                for s in range(max(1, len(row) - window + 1)) if len(row) else ():
                    out["item"].append(item)
                    out["terms"].append(row[s : s + window].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("item", pa.string()), ("terms", pa.binary())]))

    path = fresh_dir(items.sparkSession, "windows")
    named = items.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named.filter("item is not null").mapInArrow(run, "item string, terms binary").distinct().write.parquet(path)
    return path


class WindowBlock:
    """Windows with their items, terms (rows padded with 0) and lengths, ordered by their leads: the term of each that the
    fewest windows of the block have. A shard without a window's lead can't hold the window."""

    def __init__(self, items: list[str], raw: list[bytes]):
        lengths = np.asarray([len(r) // 8 for r in raw], np.int64)
        terms = np.zeros((len(raw), int(lengths.max())), np.uint64)
        for k, r in enumerate(raw):
            terms[k, : lengths[k]] = np.frombuffer(r, "<u8")
        _, inverse, counts = np.unique(terms, return_inverse=True, return_counts=True)
        often = np.where(np.arange(terms.shape[1]) < lengths[:, None], counts[inverse.reshape(terms.shape)], len(raw) * terms.shape[1] + 1)
        lead = terms[np.arange(len(raw)), often.argmin(axis=1)]
        order = np.argsort(lead, kind="stable")
        self.items, self.terms, self.lengths = [items[k] for k in order], terms[order], lengths[order]
        self.leads, self.begin = np.unique(lead[order], return_index=True)
        self.end = np.append(self.begin[1:], len(raw))

    def possible(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of the windows whose lead is among the sorted terms of a shard; the smaller side is looked up in the larger."""
        few, many = (self.leads, terms) if len(self.leads) < len(terms) else (terms, self.leads)
        at = np.searchsorted(many, few)
        here = at < len(many)
        here[here] = many[at[here]] == few[here]
        which = np.flatnonzero(here) if few is self.leads else at[here]
        size = self.end[which] - self.begin[which]
        return np.repeat(self.begin[which] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def window_blocks(path: str, block: int = WINDOW_BLOCK) -> Iterator[WindowBlock]:
    """The stored windows, at most `block` at a time."""
    fs, local = open_filesystem(path)
    import pyarrow.fs as pafs

    for info in sorted(fs.get_file_info(pafs.FileSelector(local)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(block):
                    if batch.num_rows:
                        yield WindowBlock(batch.column("item").to_pylist(), batch.column("terms").to_pylist())


def _match(postings, ranks: np.ndarray, counts: np.ndarray, slop: int) -> np.ndarray:
    """Start positions of one window, from its terms' places in the shard; the rarest term leads."""
    order = np.argsort(counts, kind="stable")
    lead = int(order[0])
    starts = postings(ranks[lead]).astype(np.int64) - lead
    for k in order[1:]:
        if not len(starts):
            break
        have = postings(ranks[k])
        place = np.searchsorted(have, starts + int(k) - slop)
        found = place < len(have)
        found[found] = have[place[found]] <= starts[found] + int(k) + slop
        starts = starts[found]
    return starts


class Shard:
    """One row of the index and what has been found in it."""

    def __init__(self, row: dict[str, bytes]):
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.terms, self.counts, self.positions, self.bounds = read("terms", "<u8"), read("counts", "<u4").astype(np.int64), read("positions", "<u4"), read("bounds", "<i8")
        self.ids, self.null = read("doc_ids", "<i8"), read("doc_null", "u1").astype(bool)
        self.ends = np.cumsum(self.counts)
        self.depth = np.zeros(int(self.bounds[-1]) + 1, np.int32)
        self.found: dict[int, set[str]] = {}

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.ends[term] - self.counts[term] : self.ends[term]]

    def search(self, block: WindowBlock, slop: int) -> None:
        if not len(self.terms):
            return
        possible, bounds = block.possible(self.terms), self.bounds
        wanted, lengths = block.terms[possible], block.lengths[possible]
        rank = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        pad = np.arange(wanted.shape[1])[None, :] >= lengths[:, None]
        for w in np.flatnonzero(((self.terms[rank] == wanted) | pad).all(axis=1)):
            n = int(lengths[w])
            starts = _match(self.postings, rank[w, :n], self.counts[rank[w, :n]], slop)
            if not len(starts):
                continue
            lo, hi = np.maximum(starts, 0), np.minimum(starts + n, bounds[-1])
            doc = np.searchsorted(bounds, lo, "right") - 1
            inside = (starts + n <= bounds[doc + 1]) & (starts >= bounds[doc]) if not slop else lo < hi
            if slop:
                hi = np.minimum(hi, bounds[doc + 1])
            np.add.at(self.depth, lo[inside], 1)
            np.add.at(self.depth, hi[inside], -1)
            for d in np.unique(doc[inside]).tolist():
                self.found.setdefault(d, set()).add(block.items[possible[w]])

    def result(self) -> pa.RecordBatch:
        hit, bounds = np.concatenate(([0], np.cumsum(np.cumsum(self.depth[:-1]) > 0))), self.bounds
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.ids, pa.int64(), mask=self.null),
                pa.array(np.diff(bounds), pa.int64()),
                pa.array(hit[bounds[1:]] - hit[bounds[:-1]], pa.int64()),
                pa.array([sorted(self.found.get(d, ())) for d in range(len(bounds) - 1)], pa.list_(pa.string())),
            ],
            ["doc_id", "n_words", "n_hit", "items"],
        )


def search_index(index: DataFrame, windows: str, slop: int = 0) -> DataFrame:
    """Every document of the index with its matches: doc_id, n_words, n_hit, items (sorted, distinct strings).

    slop 0 finds exact phrases. With slop s, a window matches at a start when its rarest term stands in its place and
    each other term occurs within s of its own; the words between the first and the last place are hit. Windows
    match inside one document only."""

    def run(batches):
        held: list[WindowBlock] | None = []
        for k, batch in enumerate(batches):
            shards = [Shard(row) for row in batch.to_pylist()]
            for block in held if k and held is not None else window_blocks(windows):
                if not k and held is not None:
                    # few windows stay in the task; more are read again for each batch of shards
                    held.append(block)
                    held = held if len(held) <= HELD_BLOCKS else None
                for shard in shards:
                    shard.search(block, slop)
            yield from (shard.result() for shard in shards)

    return index.mapInArrow(tidied(run), "doc_id long, n_words long, n_hit long, items array<string>")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Index docs, search all windows of items: one row a document, repeated rows included."""
    return search_index(build_index(docs), store_windows(items, window), slop)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)
), hits AS (SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

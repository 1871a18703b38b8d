"""Divergence of the sources of each language, term by term, in whole numbers.

Terms are found by a byte-level tokenizer: a table of 256 entries over the concatenated UTF-8 buffers of many texts says which bytes belong to terms,
and the places where that changes are their bounds. Equal terms are grouped by xxHash64, computed for all terms of one length at a time, and every
member of a group is compared with its first byte by byte. Counts for each (lang, source, term) are summed before and after a shuffle.
The kept terms of a language are dealt into buckets; a bucket holds its counts as one sparse matrix in CSR form and sums the divergences of every
two sources along its rows by reduceat. The counts absent from a row share one value, so the work grows with what is there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm._shared import discard, small_batches, stage, tidied
from tracewell.llm.words import slices, text_bytes

#: Documents of a language in which a kept term occurs at least, and terms reported for each group.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Bytes of text whose terms are grouped together, and bytes compared at a time.
SLICE_BYTES, COMPARED_BYTES = 12_000_000, 4_000_000
#: Counts of a bucket on average, and sources whose divergences from all others one task sums.
BUCKET_COUNTS, BLOCK_SOURCES = 500_000, 1000
SCALE = 1_000_000_000

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

# ---------------------------------------------------------------- terms

# The primes of xxHash64, as published.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hash_slices(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """xxHash64 of slices of data: those below 32 bytes by length, all of one length at a time; longer ones by the library."""
    out = np.empty(len(begin), np.uint64)
    for n in np.flatnonzero(np.bincount(np.minimum(length, 32))) if len(begin) else ():
        at = np.flatnonzero(length == n) if n < 32 else np.flatnonzero(length >= 32)
        if n == 32:
            out[at] = [xxhash.xxh64_intdigest(data[a : a + k].tobytes()) for a, k in zip(begin[at].tolist(), length[at].tolist(), strict=True)]
            continue
        rows = data[begin[at][:, None] + np.arange(n)]
        h, k = np.full(len(at), _P5 + np.uint64(n)), 0
        while n - k >= 8:
            lane = np.ascontiguousarray(rows[:, k : k + 8]).view("<u8")[:, 0]
            h = _turn(h ^ (_turn(lane * _P2, 31) * _P1), 27) * _P1 + _P4
            k += 8
        if n - k >= 4:
            h = _turn(h ^ (np.ascontiguousarray(rows[:, k : k + 4]).view("<u4")[:, 0].astype(np.uint64) * _P1), 23) * _P2 + _P3
            k += 4
        for j in range(k, n):
            h = _turn(h ^ (rows[:, j].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[at] = h ^ (h >> np.uint64(32))
    return out


def find_terms(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of the terms in concatenated texts with these row bounds; no term spans two rows."""
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    inside = _INSIDE[data]
    begin, end = inside.copy(), inside
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] = inside[:-1] & (~inside[1:] | edge[1:-1])
    first = np.flatnonzero(begin)
    return first, np.flatnonzero(end) + 1 - first


def _spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.repeat(begin - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)


def group_slices(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings equal slices together and keeps their sequence, number of each in that order): slices are equal by
    their bytes, whatever their hashes."""
    hashes = hash_slices(data, begin, length)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(order) else np.empty(0, bool)
    number = np.cumsum(new) - 1
    a, n = begin[order], length[order]
    first = np.flatnonzero(new)[number] if len(order) else number
    differs = n != n[first]
    sizes = np.cumsum(n)
    k = 0
    while k < len(order):  # bytes of the rest, some at a time
        stop = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + COMPARED_BYTES, "right")))
        like = np.flatnonzero(~differs[k:stop] & ~new[k:stop]) + k
        if len(like):
            unequal = data[_spread(a[like], n[like])] != data[_spread(a[first[like]], n[like])]
            bounds = np.cumsum(n[like]) - n[like]
            differs[like[np.logical_or.reduceat(unequal, bounds)]] = True
        k = stop
    if differs.any():  # different slices of one hash: told apart by their bytes
        names: dict[tuple[int, bytes], int] = {}
        for k in np.flatnonzero(differs).tolist():
            text = data[a[k] : a[k] + n[k]].tobytes()
            number[k] = names.setdefault((int(number[k]), text), int(new.sum()) + len(names))
        again = np.argsort(number, kind="stable")
        order, number = order[again], number[again]
    return order, number


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def term_counts(docs: DataFrame) -> DataFrame:
    """text, lang, source -> lang, source, term, n (occurrences), docs (documents with it), over all documents."""
    small_batches(docs.sparkSession, 4096)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                held.append(part)
                size += part.column("text").nbytes
                if size > SLICE_BYTES:
                    yield from _counted(held)
                    held, size = [], 0
        yield from _counted(held)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("text"), text("lang"), text("source")).mapInArrow(tidied(run), "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    (lang, langs), (source, sources) = (_codes(table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0)) for c in ("lang", "source"))
    group = lang * len(sources) + source
    by_group = np.argsort(group, kind="stable")
    texts = table["text"].combine_chunks() if table["text"].num_chunks != 1 else table["text"].chunk(0)
    data, rows = text_bytes(texts.cast(pa.large_string()).take(pa.array(by_group)))
    data, group = _LOWER[data], group[by_group]
    begin, length = find_terms(data, rows)
    if not len(begin):
        return
    order, number = group_slices(data, begin, length)
    # within a term its documents follow one another, those of a group together
    doc = (np.searchsorted(rows, begin, "right") - 1)[order]
    of = group[doc]
    turn = number[1:] != number[:-1]
    new = np.concatenate(([True], turn | (of[1:] != of[:-1])))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order)))
    other = np.concatenate(([True], turn | (doc[1:] != doc[:-1])))
    a, size = begin[order[first]], length[order[first]]
    ends = np.concatenate(([0], np.cumsum(size)))
    terms = pa.Array.from_buffers(pa.large_string(), len(a), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data[_spread(a, size)].tobytes())])
    of = of[first]
    columns = [langs.take(pa.array(of // len(sources))), sources.take(pa.array(of % len(sources))), terms.cast(pa.string()), pa.array(n), pa.array(np.add.reduceat(other, first, dtype=np.int64))]
    out = pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
    for k in range(0, out.num_rows, 20_000):
        yield out.slice(k, 20_000)


# ---------------------------------------------------------------- divergences


def scaled(counts: np.ndarray, total: int | np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), exact: three steps of 1000, so that no product passes 64 bits."""
    total = np.asarray(total, np.int64)
    rest, out = counts.astype(np.int64) + 2, np.zeros(len(counts), np.int64)
    for _ in range(3):
        whole, rest = np.divmod(rest, total)
        out, rest = (out + whole) * 1000, rest * 1000
    return 1 + out + rest // total


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each CSR row, 0 for empty ones."""
    out = np.zeros(len(bounds) - 1, np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full])
    return out


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _bucket(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """One bucket of a language's terms: sums of divergence between the sources of one block and all others, and the first terms of each of the block."""
    lang, block = key[0].as_py(), key[2].as_py()
    sources = groups["source"].combine_chunks()
    total = groups["total"].to_numpy()
    mine = np.flatnonzero(groups["block"].to_numpy() == block)
    kept = int(groups["kept"][0].as_py()) if groups.num_rows else 0
    if not len(mine):
        return _FOUND.empty_table()
    row = pc.index_in(counts["source"], sources).to_numpy().astype(np.int64)
    column, terms = _codes(counts["term"].combine_chunks()) if counts.num_rows else (np.empty(0, np.int64), pa.array([], pa.string()))
    order = np.lexsort((column, row))
    row, column, n = row[order], column[order], counts["n"].to_numpy()[order]
    bounds = np.searchsorted(row, np.arange(len(sources) + 1))
    below = np.maximum(total + 2 * kept, 1)
    p, absent = scaled(n, below[row]), scaled(np.zeros(len(sources), np.int64), below)
    everywhere = np.zeros(len(terms), np.int64)
    np.add.at(everywhere, column, n)
    q = scaled(everywhere, max(int(total.sum()) + 2 * kept, 1))
    out = []
    for a in mine.tolist():
        lo, hi = bounds[a], bounds[a + 1]
        full = np.full(len(terms), absent[a])
        full[column[lo:hi]] = p[lo:hi]
        # against sources in which all terms are absent, then what their own counts change
        value = (len(terms) - (hi - lo)) * divergence(absent[a], absent)
        for k in range(lo, hi, 4096):
            value += divergence(p[k : min(hi, k + 4096), None], absent[None, :]).sum(axis=0)
        value += _row_sums(divergence(full[column], p) - divergence(full[column], absent[row]), bounds)
        others = np.delete(np.arange(len(sources)), a)
        name = sources[a].as_py()
        out.append(_rows(lang, name, "pair", sources.take(pa.array(others)), value[others]))
        of, have = q[column[lo:hi]], p[lo:hi]
        more = np.flatnonzero(have > of)
        f = divergence(have[more], of[more])
        if len(f) > TOP_TERMS:
            sure = f >= np.partition(f, len(f) - TOP_TERMS)[len(f) - TOP_TERMS]
            more, f = more[sure], f[sure]
        names = terms.take(pa.array(column[lo + more])).to_pylist()
        best = sorted(range(len(f)), key=lambda k: (-int(f[k]), names[k].encode()))[:TOP_TERMS]
        out.append(_rows(lang, name, "term", pa.array([names[k] for k in best], pa.string()), f[best] if best else f[:0]))
    return pa.concat_tables(out).combine_chunks()


def _rows(lang: str, source: str, part: str, items: pa.Array, values: np.ndarray) -> pa.Table:
    same = lambda x: pa.array([x] * len(items), pa.string())
    return pa.Table.from_arrays([same(lang), same(source), same(part), items.cast(pa.string()), pa.array(values, pa.int64())], schema=_FOUND)


def audit(docs: DataFrame) -> DataFrame:
    """text, lang, source (null: '') -> lang, source, part, item, value, rank: of every group its divergence from each other source of its language, and
    the TOP_TERMS terms by which it departs most from the language.

    Repeated rows are documents of their own; null and empty texts have no terms, yet their group counts; a language without kept terms has pairs of value 0;
    a language with one source has no pairs; an empty table gives no rows; other columns are not read."""
    counts = stage(term_counts(docs), "terms")
    word = Window.partitionBy("lang", "term")
    kept = counts.withColumn("among", F.sum("docs").over(word)).filter(F.col("among") >= LEAST_DOCS)
    kept = stage(kept.withColumn("leads", (F.col("source") == F.min("source").over(word)).cast("long")).select("lang", "source", "term", "n", "leads"), "kept")
    discard(counts)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    every = docs.select(text("lang"), text("source")).distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("leads").alias("leads"), F.count(F.lit(1)).alias("rows")), ["lang", "source"], "left").na.fill(0)
    every = stage(every, "groups")
    langs = every.groupBy("lang").agg(F.sum("leads").alias("kept"), F.ceil(F.sum("rows") / BUCKET_COUNTS).alias("buckets"), F.ceil(F.count(F.lit(1)) / BLOCK_SOURCES).alias("blocks"))
    langs = stage(langs.select("lang", "kept", F.greatest("buckets", F.lit(1)).cast("int").alias("buckets"), F.col("blocks").cast("int").alias("blocks")), "langs")

    dealt = lambda df, what, many: df.withColumn(what, F.explode(F.sequence(F.lit(0), F.col(many) - 1)))
    left = dealt(kept.join(langs, "lang").withColumn("bucket", F.pmod(F.hash("term"), F.col("buckets"))), "part", "blocks").select("lang", "bucket", "part", "source", "term", "n")
    right = every.join(langs, "lang").withColumn("block", F.pmod(F.hash("source"), F.col("blocks")))
    right = dealt(dealt(right, "bucket", "buckets"), "part", "blocks").select("lang", "bucket", "part", "source", "total", "kept", "block")
    by = ["lang", "bucket", "part"]
    found = stage(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_bucket, "lang string, source string, part string, item string, value long"), "divergences")
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term lies in one bucket
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item")))
    return summed.withColumn("rank", place).filter((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
tokens AS (SELECT id, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM tokens GROUP BY 1, 2 HAVING count(DISTINCT id) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM docs),
c AS (SELECT lang, source, term, count(*) AS c FROM tokens JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p FROM groups g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
 LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (s + 2)) // (t + 2 * v.v) AS q FROM (SELECT lang, term, sum(c) AS s FROM c GROUP BY 1, 2) JOIN (SELECT lang, sum(c) AS t FROM c GROUP BY 1) USING (lang) JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, source, 'term' AS part, p.term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= {TOP_TERMS}"""

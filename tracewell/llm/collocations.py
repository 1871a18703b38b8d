"""Phrase collocations: exact counts of one to four words in a row, scored by how seldom their parts occur apart.

1. Equal pieces of one language become one row with a multiplicity, kept in units of about UNIT_CHARS characters; a unit numbers its own words.
2. Each round asks for the counts of what a unit holds: words first, then pairs of neighbouring frequent phrases one word shorter (no phrase is
   frequent whose parts are not, so nothing is lost). Requests are shuffled by what they ask for, so that one hash bucket holds all of a phrase's
   parts; the bucket sums the weights in duckdb, which spills beyond its memory, numbers what is frequent and answers the units that asked.
   Phrases are told apart by the numbers of their parts, and words by their text, never by a hash alone.
3. Parts of a phrase are looked up by their numbers in shuffled joins of the frequent phrases.

A left part that occurs often is dealt out over several buckets by its right parts; a unit sends one sum for each different phrase.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm._shared import discard, small_batches, stage, tidied

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNDETERMINED = "und"
#: Least occurrences of a phrase, most words, and phrases reported for each language.
LEAST, WORDS, TOP = 30, 4, 2000
#: A candidate within a longer one of at least so many percent of its occurrences is dropped.
COVERED_PERCENT = 80
UNIT_CHARS = 8_000_000
#: Rows whose texts are cut into pieces together.
CUT_ROWS = 256
#: Requests that a bucket counts, on average, and the occurrences of a left part beyond which it has more than one bucket.
BUCKET_REQUESTS, LEFT_OCCURRENCES = 4_000_000, 1 << 20
#: Memory of a bucket's tables beyond which duckdb spills to Spark's own scratch folder of the executor.
BUCKET_MEMORY = "400MB"
#: Parts into which a language's candidates are ranked before their firsts are ranked together.
RANK_PARTS = 64


#: Bytes in the form in which pieces are compared; none of them is part of a longer UTF-8 sequence.
_FORM = bytes.maketrans(f"{CAPITALS}.,;:!?\v\f\r\t".encode(), f"{SMALL}{chr(10) * 9} ".encode())


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, piece, m: the pieces of some rows, each once."""
    for rows in (batch.slice(k, CUT_ROWS) for batch in batches for k in range(0, batch.num_rows, CUT_ROWS)):
        sizes = pc.binary_length(rows.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        data = _raw(rows.column("text").cast(pa.binary()), "u1").tobytes().translate(_FORM)
        text = pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes)))), pa.py_buffer(data)])
        while pc.any(pc.match_substring(text, "  ")).as_py():
            text = pc.replace_substring(text, "  ", " ")
        lists = pc.split_pattern(text, "\n")
        pieces = pa.table({"lang": rows.column("lang").take(pc.list_parent_indices(lists)), "piece": pc.ascii_trim(lists.flatten(), " ")})
        found = pieces.filter(pc.not_equal(pieces["piece"], "")).group_by(["lang", "piece"], use_threads=False).aggregate([([], "count_all")])
        out = found.select(["lang", "piece", "count_all"]).rename_columns(["lang", "piece", "m"]).cast(pa.schema([("lang", pa.string()), ("piece", pa.string()), ("m", pa.int64())]))
        yield from out.combine_chunks().to_batches()


def distinct_pieces(docs: DataFrame) -> DataFrame:
    """text, lang -> lang, piece (words joined by one space), m: equal pieces counted, in a batch, before the shuffle and after."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNDETERMINED))
    texts = docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return texts.mapInArrow(tidied(_cut), "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces -> units: lang, its words with their weights, and its pieces of two words or more as word numbers, each ended by -1."""
    number = TaskContext.get().partitionId() << 33

    def flush(held):
        nonlocal number
        table = pa.Table.from_batches(held)
        for lang in pc.unique(table["lang"]).to_pylist():
            part = table.filter(pc.equal(table["lang"], lang)).combine_chunks()
            lists = pc.split_pattern(part["piece"].combine_chunks(), " ")
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            codes, m = coded.indices.to_numpy(zero_copy_only=False), part["m"].to_numpy()
            _, weights, _ = _sums(codes, np.repeat(m, lengths))
            long = lengths > 1
            body = codes[np.repeat(long, lengths)]
            stops = np.cumsum(lengths[long])
            yield _row(
                unit=number, lang=lang, n=int(weights.sum()), words=coded.dictionary.to_pylist(), weights=weights.tolist(),
                codes=np.insert(body, stops, -1).astype(np.int32).tobytes(), m=m[long].tobytes(),
            )
            number += 1

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("piece").nbytes
        if size > UNIT_CHARS:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


_UNIT = pa.schema([("unit", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())), ("weights", pa.list_(pa.int64())), ("codes", pa.binary()), ("m", pa.binary())])


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([values], schema=_UNIT)


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sum of the weights of each, place of each key among the distinct ones), exact."""
    if not len(keys):
        return keys, np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    first, places = np.flatnonzero(new), np.empty(len(keys), np.int64)
    places[order] = np.cumsum(new) - 1
    return ranked[first], np.add.reduceat(weights[order].astype(np.int64), first), places


# ---------------------------------------------------------------- buckets


def _counted(keys: dict[str, str], unpack: Callable[[pa.RecordBatch], pa.Table], answers: bool, least: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Requests of one bucket -> its frequent phrases (id, their keys, f), and for each unit that asked the places, ids and counts of those it holds."""
    names = ", ".join(keys)
    schema = pa.schema([("id", pa.int64()), *((k, pa.string() if t == "VARCHAR" else pa.int64()) for k, t in keys.items()), ("f", pa.int64()), ("unit", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("places", "ids", "counts"))])

    def run(batches):
        import duckdb

        scratch = tempfile.mkdtemp(prefix="bucket-", dir=SparkFiles.getRootDirectory())
        con = duckdb.connect(config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": scratch, "preserve_insertion_order": False})
        try:
            con.execute(f"CREATE TABLE asked ({', '.join(f'{k} {t}' for k, t in keys.items())}, w BIGINT, unit BIGINT, place BIGINT)")
            for batch in batches:
                con.register("incoming", unpack(batch))
                con.execute("INSERT INTO asked SELECT * FROM incoming")
                con.unregister("incoming")
            first = TaskContext.get().partitionId() << 36
            con.execute(f"CREATE TABLE found AS SELECT {first} + row_number() OVER (ORDER BY {names}) AS id, {names}, f FROM (SELECT {names}, sum(w)::BIGINT AS f FROM asked GROUP BY {names} HAVING sum(w) >= {least})")
            nothing = ", ".join(f"NULL::{t} AS {k}" for k, t in keys.items())
            yield from _batches(con.sql(f"SELECT id, {names}, f, NULL::BIGINT AS unit, NULL::BIGINT[] AS places, NULL::BIGINT[] AS ids, NULL::BIGINT[] AS counts FROM found"), schema)
            if answers:
                yield from _batches(con.sql(f"SELECT NULL::BIGINT AS id, {nothing}, NULL::BIGINT AS f, unit, list(place) AS places, list(id) AS ids, list(f) AS counts FROM asked JOIN found USING ({names}) GROUP BY unit"), schema)
        finally:
            con.close()
            shutil.rmtree(scratch, ignore_errors=True)

    return run


def _batches(result, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in result.fetch_arrow_reader(20_000):
        yield pa.RecordBatch.from_arrays([batch.column(c.name).cast(c.type) for c in schema], schema=schema)


def _count(asked: DataFrame, n: int, by: list[str], keys: dict[str, str], unpack, answers: bool, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all of it as stored, frequent phrases, answers) for requests dealt out by `by`."""
    buckets = max(asked.sparkSession.sparkContext.defaultParallelism, -(-n // BUCKET_REQUESTS))
    columns = ", ".join(f"{k} {'string' if t == 'VARCHAR' else 'long'}" for k, t in keys.items())
    stored = stage(asked.repartition(buckets, *by).mapInArrow(tidied(_counted(keys, unpack, answers, least)), f"id long, {columns}, f long, unit long, places array<long>, ids array<long>, counts array<long>"), "phrases")
    return stored, stored.filter("id is not null").select("id", *keys, "f"), stored.filter("unit is not null").select("unit", "places", "ids", "counts")


def count_words(units: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = units.select("lang", "unit", F.posexplode(F.arrays_zip("words", "weights"))).select("lang", F.col("col.words").alias("word"), F.col("col.weights").alias("w"), "unit", F.col("pos").cast("long").alias("place"))
    n = units.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
    return _count(asked, n, ["lang", "word"], {"lang": "VARCHAR", "word": "VARCHAR"}, lambda batch: pa.Table.from_batches([batch]), True, least)


def _raw(column: pa.Array, kind: str) -> np.ndarray:
    """All values of a column of binary arrays, one after another."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data is not None and len(column) else np.empty(0, kind)


def _unpack_pairs(batch: pa.RecordBatch) -> pa.Table:
    sizes = pc.binary_length(batch.column("rights")).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    many = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes))
    each = lambda c: pa.array(_raw(batch.column(c), "<i8"))
    return pa.table({"left_id": many("left_id"), "right_id": each("rights"), "w": each("sums"), "unit": many("unit"), "place": each("places")})


_STATE = "unit long, codes binary, m binary, n_pairs long, lefts binary, rights binary, sums binary, left_counts binary"


def _pairs(key: tuple, state: pa.Table, answers: pa.Table) -> pa.Table:
    """A unit's phrases of one word more: its places become numbers of distinct pairs of frequent neighbours, its runs the pieces of the next round."""
    schema = pa.schema([("unit", pa.int64()), ("codes", pa.binary()), ("m", pa.binary()), ("n_pairs", pa.int64()), *((c, pa.binary()) for c in ("lefts", "rights", "sums", "left_counts"))])
    if not state.num_rows or not answers.num_rows:
        return schema.empty_table()
    codes, m = np.frombuffer(state["codes"][0].as_py(), np.int32), np.frombuffer(state["m"][0].as_py(), np.int64)
    if not len(codes):
        return schema.empty_table()
    flat = lambda c: answers[c].combine_chunks().flatten().to_numpy()
    places = flat("places")
    size = max(int(codes.max()), int(places.max())) + 1
    ids, counts = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    ids[places], counts[places] = flat("ids"), flat("counts")
    known = (codes >= 0) & (ids[codes] >= 0)
    both = known[:-1] & known[1:]
    at = np.flatnonzero(both)
    if not len(at):
        return schema.empty_table()
    weights = m[np.cumsum(codes < 0)[at]]
    keys = codes[at].astype(np.int64) * size + codes[at + 1]
    distinct, sums, numbered = _sums(keys, weights)
    lefts, rights = distinct // size, distinct % size
    # runs of two pairs or more are searched for longer phrases
    begin = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
    lengths = np.diff(np.append(begin, len(at)))
    inside = np.repeat(lengths > 1, lengths)
    left = np.insert(numbered[inside], np.cumsum(lengths[lengths > 1]), -1).astype(np.int32)
    row = {
        "unit": key[0].as_py(), "codes": left.tobytes(), "m": weights[begin[lengths > 1]].tobytes(), "n_pairs": len(distinct), "lefts": ids[lefts].tobytes(),
        "rights": ids[rights].tobytes(), "sums": sums.tobytes(), "left_counts": counts[lefts].tobytes(),
    }
    return pa.Table.from_pylist([row], schema=schema)


def _requests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A unit's distinct pairs -> one row for each left part and share of its right parts."""
    names = ["left_id", "share", "unit", "rights", "sums", "places"]
    for batch in batches:
        for row in batch.to_pylist():
            left, right, sums, counts = (np.frombuffer(row[c], np.int64) for c in ("lefts", "rights", "sums", "left_counts"))
            shares = 1 + counts // LEFT_OCCURRENCES
            # the numbers of right parts follow their order in a bucket, so their low bits spread well
            share = right % shares
            order = np.lexsort((share, left))
            a, b = left[order], share[order]
            begin = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            ends = (np.append(begin, len(a)) * 8).astype(np.int32)
            packed = [pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.astype(np.int64).tobytes())]) for x in (right[order], sums[order], order)]
            out = pa.RecordBatch.from_arrays([pa.array(a[begin]), pa.array(b[begin].astype(np.int32)), pa.array(np.full(len(begin), row["unit"])), *packed], names)
            for k in range(0, out.num_rows, 4096):
                yield out.slice(k, 4096)


def count_pairs(state: DataFrame, answers: DataFrame, more: bool, least: int = LEAST) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    """(the units' next state, counts of their pairs) after the answers about their parts."""
    paired = stage(state.select("unit", "codes", "m").groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_pairs, _STATE), "units")
    n = paired.agg(F.sum("n_pairs")).first()[0] or 0
    asked = paired.select("unit", "lefts", "rights", "sums", "left_counts").mapInArrow(tidied(_requests), "left_id long, share int, unit long, rights binary, sums binary, places binary")
    return paired, _count(asked, n, ["left_id", "share"], {"left_id": "BIGINT", "right_id": "BIGINT"}, _unpack_pairs, more, least)


# ---------------------------------------------------------------- phrases


def _scored(cuts: list[tuple[str, str]]) -> Column:
    """The lowest-scoring cut (score, k, l, r) of a candidate that occurs a times, ties to the smallest k."""
    score = lambda x, y: F.expr(f"(cast(a as decimal(19, 0)) * 2000000BD) div (cast({x} as decimal(19, 0)) + cast({y} as decimal(19, 0)))")
    options = [F.struct(score(x, y).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate(cuts, 1)]
    return F.least(*options) if len(options) > 1 else options[0]


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """text, lang -> lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two to four words that
    occur at least `least` times.

    Null texts have no words, a null lang is 'und'; repeated rows count as often as they occur; other columns are not read; an empty table,
    or one without such phrases, gives no rows. Ties of score go to the higher count, then to the phrase in UTF-8 byte order."""
    small_batches(docs.sparkSession, 4096)
    units = stage(distinct_pieces(docs).mapInArrow(tidied(_units), "unit long, lang string, n long, words array<string>, weights array<long>, codes binary, m binary"), "units")
    totals = units.groupBy("lang").agg(F.sum("n").alias("n"))
    stored, words, answers = count_words(units, least)
    state, levels, kept = units, [], [units, stored]
    for length in range(2, WORDS + 1):
        state, (stored, found, answers) = count_pairs(state, answers, length < WORDS, least)
        levels.append(found)
        kept += [state, stored]
    phrases = _looked_up(words, *levels)
    ranked = stage(_ranked(*phrases, totals, top), "collocations")
    discard(*kept, *phrases)
    return ranked


def _ranked(two: DataFrame, three: DataFrame, four: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    inner = lambda df, *ids: df.select(F.explode(F.array(*map(F.col, ids))).alias("id"), F.col("a").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
    longer2 = inner(three, "left_id", "right_id").unionByName(inner(four, "first2", "middle2", "last2")).groupBy("id").agg(F.max("longer").alias("longer"))
    longer3 = inner(four, "left_id", "right_id")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    alone = F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * COVERED_PERCENT)
    parts = [
        two.join(longer2, "id", "left").filter(alone).select("lang", "phrase", "a", _scored([("f_first", "f_last")]).alias("cut")),
        three.join(longer3, "id", "left").filter(alone).select("lang", "phrase", "a", _scored([("f_first", "a_right"), ("a_left", "f_last")]).alias("cut")),
        four.select("lang", "phrase", "a", _scored([("f_first", "a_right"), ("a_first2", "a_last2"), ("a_left", "f_last")]).alias("cut")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = every.withColumn("part", F.pmod(F.hash("phrase"), F.lit(RANK_PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _looked_up(words: DataFrame, pairs: DataFrame, triples: DataFrame, fours: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases with their text and the counts of their parts, found by the parts' numbers; stored, for several steps read each."""

    def parts(df: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        sides = [side.select(*(F.col(c).alias(f"{mark}_{c}") for c in side.columns)) for mark, side in (("x", left), ("y", right))]
        return df.join(sides[0], F.col("left_id") == F.col("x_id")).join(sides[1], F.col("right_id") == F.col("y_id"))

    text = lambda y: F.concat_ws(" ", "x_phrase", y).alias("phrase")
    single = words.select("id", "lang", F.col("word").alias("phrase"), F.col("f").alias("a"))
    two = stage(parts(pairs, single, single).select("id", "left_id", "right_id", F.col("x_lang").alias("lang"), text("y_phrase"), F.col("f").alias("a"), F.col("y_phrase").alias("tail"), F.col("x_a").alias("f_first"), F.col("y_a").alias("f_last")), "pairs")
    ends = [F.col("id"), F.col("left_id"), F.col("right_id"), F.col("x_lang").alias("lang"), text("y_tail"), F.col("f").alias("a"), F.col("y_tail").alias("tail"), F.col("x_f_first").alias("f_first"), F.col("y_f_last").alias("f_last"), F.col("x_a").alias("a_left"), F.col("y_a").alias("a_right")]
    three = stage(parts(triples, two, two).select(*ends), "triples")
    four = stage(parts(fours, three, three).select(
        *ends, F.col("x_a_left").alias("a_first2"), F.col("y_a_right").alias("a_last2"), F.col("x_left_id").alias("first2"), F.col("x_right_id").alias("middle2"), F.col("y_right_id").alias("last2")
    ), "fours")
    return two, three, four


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _grams_sql(k: int) -> str:
    return f"SELECT lang, {k} AS k, unnest([array_to_string(w[i:i + {k - 1}], ' ') for i in range(1, len(w) - {k} + 2)]) AS g FROM words WHERE len(w) >= {k}"


ORACLE = f"""WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}') AS x FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^ \\t]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\\x0A-\\x0D]')) AS p FROM texts)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY 1),
f AS (SELECT lang, k, g, count(*) AS a FROM ({' UNION ALL '.join(_grams_sql(k) for k in range(1, WORDS + 1))}) GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
c AS (SELECT *, string_split(g, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, k, g, a, j, array_to_string(w[1:j], ' ') AS gl, array_to_string(w[j + 1:k], ' ') AS gr FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (SELECT cuts.lang, cuts.k, cuts.g, cuts.a, j, x.a AS l, y.a AS r, ((2000000::HUGEINT * cuts.a) // (x.a::HUGEINT + y.a))::BIGINT AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = gl AND x.k = j JOIN f y ON y.lang = cuts.lang AND y.g = gr AND y.k = cuts.k - j),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, g ORDER BY score, j) = 1),
inner_ AS (SELECT lang, a, s, array_to_string(w[i:i + s - 1], ' ') AS g FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM c))),
covered AS (SELECT lang, s AS k, g, max(a) AS longer FROM inner_ GROUP BY 1, 2, 3),
left_ AS (SELECT lowest.* FROM lowest LEFT JOIN covered USING (lang, k, g) WHERE longer IS NULL OR 100::HUGEINT * longer < {COVERED_PERCENT}::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score FROM left_ JOIN totals USING (lang)
QUALIFY rank <= {TOP}"""

"""Texts that may be shared: names of any number replaced by placeholders in one pass, with a dictionary built from the data.

The dictionary is read in shards of bounded size; an automaton of a shard finds all its terms in a text at once. Which matches count is decided when all
shards have been searched: longer terms first, then from left to right, none within another. So the result is that of replacing terms one by
one, longest first, without ever looking into what was put in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut

#: Terms whose automaton a worker holds at a time (about 300 bytes each).
SHARD = 200_000
_MATCHES = "array<struct<begin:int,end:int,term:string,put:string>>"


def numbered_placeholders(values: DataFrame, category: str, value: str, seen: str) -> DataFrame:
    """category, value, placeholder CATEGORY_001 ... in first-seen order of distinct values; numbers from 1000 on are whole.

    Values are ordered by range partitions and numbered within them; the counts of earlier partitions are added, so no category is one task."""
    firsts = values.filter(F.col(value).isNotNull()).groupBy(category, value).agg(F.min(seen).alias("first_"))
    ordered = cut(firsts.repartitionByRange(F.col(category), F.col("first_"), F.col(value)).withColumn("part_", F.spark_partition_id()))
    counts = ordered.groupBy(category, "part_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(category).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = counts.select(F.col(category).alias("c_"), F.col("part_").alias("p_"), before.alias("before_"))
    inside = F.row_number().over(Window.partitionBy("part_", category).orderBy("first_", value))
    placed = ordered.withColumn("inside_", inside).join(offsets, F.col(category).eqNullSafe(F.col("c_")) & (F.col("part_") == F.col("p_")))
    number = (F.col("before_") + F.col("inside_")).cast("string")
    return placed.select(category, value, F.concat(F.upper(category), F.lit("_"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("placeholder"))


def _kept(matches: list[dict]) -> list[dict]:
    """Matches of one text that count, from left to right."""
    taken, out = set(), []
    for m in sorted(matches, key=lambda m: (m["begin"] - m["end"], m["term"], m["begin"])):
        places = range(m["begin"], m["end"])
        if taken.isdisjoint(places):
            taken.update(places)
            out.append(m)
    return sorted(out, key=lambda m: m["begin"])


def replace_dictionary(texts: DataFrame, column: str, dictionary: DataFrame, whole_words: bool = False, shard: int = SHARD) -> DataFrame:
    """texts with the terms of dictionary(term, placeholder) in a text column replaced, longest first. With whole_words a term counts only where no letter,
    digit or underscore touches it. Of equal terms the least placeholder counts; null and empty terms do nothing, null texts stay; case is kept apart."""
    spark = texts.sparkSession
    terms = dictionary.filter("term <> ''").groupBy("term").agg(F.min("placeholder").alias("put"))
    n = terms.count()
    shards = max(1, -(-n // shard))
    terms = cut(terms.withColumn("shard_", F.pmod(F.xxhash64("term"), F.lit(shards))))
    rows = texts.withColumn("matches_", F.array().cast(_MATCHES))
    schema = rows.schema
    for k in range(shards if n else 0):
        held = spark.sparkContext.broadcast(terms.filter(F.col("shard_") == k).select("term", "put").toPandas().to_dict("split")["data"])  # at most about a shard's terms

        def search(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for term, put in held.value:
                automaton.add_word(term, (term, put))
            if held.value:
                automaton.make_automaton()
            for batch in batches:
                place = batch.schema.get_field_index("matches_")
                out = batch.column(place).to_pylist()
                for found, text in zip(out, batch.column(batch.schema.get_field_index(column)).to_pylist(), strict=True):
                    for last, (term, put) in automaton.iter(text) if text and held.value else ():
                        begin, end = last + 1 - len(term), last + 1
                        if not whole_words or not (begin and _inside(text[begin - 1]) or end < len(text) and _inside(text[end])):
                            found.append({"begin": begin, "end": end, "term": term, "put": put})
                yield batch.set_column(place, "matches_", pa.array(out, batch.column(place).type))

        rows = rows.mapInArrow(search, schema)
        if k < shards - 1:
            rows = cut(rows)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, place = batch.schema.get_field_index(column), batch.schema.get_field_index("matches_")
            out = []
            for text, matches in zip(batch.column(at).to_pylist(), batch.column(place).to_pylist(), strict=True):
                if not matches:
                    out.append(text)
                    continue
                parts, done = [], 0
                for m in _kept(matches):
                    parts += [text[done : m["begin"]], m["put"]]
                    done = m["end"]
                out.append("".join(parts) + text[done:])
            yield batch.set_column(at, column, pa.array(out, pa.string())).drop_columns(["matches_"])

    return rows.mapInArrow(apply, texts.schema)


def _inside(char: str) -> bool:
    return char.isalnum() or char == "_"


def shared_rows(texts: DataFrame, column: str, values: DataFrame, category: str, value: str, seen: str) -> tuple[DataFrame, DataFrame]:
    """(texts without the names of values, the dictionary): one placeholder a distinct value, in first-seen order of its category."""
    dictionary = cut(numbered_placeholders(values, category, value, seen))
    return replace_dictionary(texts, column, dictionary.select(F.col(value).alias("term"), "placeholder"), whole_words=True), dictionary

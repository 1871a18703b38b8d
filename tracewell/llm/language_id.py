"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of (language, bucket) are gathered per task and summed in Spark; the log-probability matrix (BUCKETS x languages,
in blocks of languages) is broadcast and whole texts are scored in numpy as sparse rows: every n-gram adds its bucket's
row of the matrix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._shared import small_batches, tidied
from tracewell.llm.words import slice_bounds

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
#: Bytes of the matrix of one block of languages.
MATRIX_BYTES = 64 << 20
#: Bound of the fit: about so many labelled documents, chosen by a hash of the id, are counted.
MAX_FIT_DOCS = 20_000
SMOOTHING = 0.1
UNDETERMINED = "und"
_CHUNK = 400_000
#: Texts of about so many bytes are scored together.
SLICE_BYTES = 4_000_000

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with all but letters as blanks, each text led and followed by one blank; text bounds."""
    letters = _letter_table()
    blank = np.asarray([0x20], np.uint32)
    rows = [np.concatenate((blank, np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4"), blank)) for t in texts]
    data = np.concatenate(rows) if rows else np.empty(0, np.uint32)
    return np.where(letters[data], data, np.uint32(0x20)), np.cumsum([0, *(len(r) for r in rows)])


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram that holds a letter, number of its text), text by text for each order."""
    data, bounds = _characters(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    wide, letter = data.astype(np.uint64), data != 0x20
    buckets, owners = [], []
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        key, some = np.full(m, n, np.uint64), np.zeros(m, bool)
        for k in range(n):
            key = key * np.uint64(0x100000001B3) + wide[k : k + m]
            some |= letter[k : k + m]
        some &= text[:m] == text[n - 1 :]
        if n > 1:
            # a gram and its blank-led neighbour differ; runs of blanks are left out
            some &= ~(~letter[:m] & ~letter[1 : m + 1])
        key = key[some] * np.uint64(0x9E3779B97F4A7C15)
        buckets.append(((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(text[:m][some])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


class LanguageModel:
    """languages in order, log-probabilities (BUCKETS x languages, float32), log priors."""

    def __init__(self, languages: list[str], log_prob: np.ndarray, log_prior: np.ndarray):
        self.languages, self.log_prob, self.log_prior = languages, log_prob, log_prior

    def blocks(self) -> list[LanguageModel]:
        """The model as blocks of languages whose matrices hold at most MATRIX_BYTES; one block for few languages."""
        step = max(1, MATRIX_BYTES // (4 * BUCKETS))
        cuts = range(0, max(1, len(self.languages)), step)
        return [LanguageModel(self.languages[k : k + step], np.ascontiguousarray(self.log_prob[:, k : k + step]), self.log_prior[k : k + step]) for k in cuts]

    def totals(self, bucket: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Log-likelihood plus log prior of each text and language."""
        total = np.tile(self.log_prior, (texts, 1))
        step = max(1000, min(_CHUNK, 16_000_000 // max(1, len(self.languages))))
        for c in range(0, len(bucket) if self.languages else 0, step):
            part = owner[c : c + step]
            heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            total[part[heads]] += np.add.reduceat(self.log_prob[bucket[c : c + step]], heads, axis=0, dtype=np.float64)
        return total

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, posterior probability) of whole texts; und and 0 without a letter or without a model."""
        return score_blocks([self], texts)


def score_blocks(blocks: list[LanguageModel], texts: list[str]) -> tuple[list[str], np.ndarray]:
    """score() by all blocks of a model; of languages that tie, the first in order is taken."""
    languages = [x for block in blocks for x in block.languages]
    names, scores = [], np.zeros(len(texts))
    for a, b in slice_bounds([len(t) for t in texts], _CHUNK):
        bucket, owner = ngrams(texts[a:b])
        known = np.bincount(owner, minlength=b - a) > 0
        if not languages:
            known[:] = False
            names += [UNDETERMINED] * (b - a)
            continue
        total = np.concatenate([block.totals(bucket, owner, b - a) for block in blocks], axis=1)
        best = total.argmax(axis=1)
        scores[a:b] = np.where(known, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
        names += [languages[j] if ok else UNDETERMINED for j, ok in zip(best.tolist(), known.tolist(), strict=True)]
    return names, scores


def fit(labelled: DataFrame, max_docs: int = MAX_FIT_DOCS) -> LanguageModel:
    """labelled(doc_id, text, lang) -> model, from rows with text and lang: about max_docs / languages of each language, chosen by
    a hash of the id (all of a rarer one), so that none is without documents; priors are the shares of all rows.

    At most languages * BUCKETS counts reach the driver, as Arrow; a language costs 4 * BUCKETS bytes there. No such row: an
    empty model."""
    known = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not rows:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    languages, million = sorted(rows), 1_000_000
    number = {x: k for k, x in enumerate(languages)}
    # what rarer languages leave of their shares goes to the others
    left, share = max_docs, {}
    for k, x in enumerate(sorted(languages, key=lambda x: rows[x])):
        fair = left / (len(languages) - k)
        share[x] = min(million, max(1, int(million * fair / rows[x])))
        left -= min(fair, rows[x])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, place = batch.column("text").to_pylist(), [number[x] for x in batch.column("lang").to_pylist()]
            for a, b in slice_bounds([len(t) for t in texts], _CHUNK):
                bucket, owner = ngrams(texts[a:b])
                key, n = np.unique(np.asarray(place[a:b])[owner] * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    shares = labelled.sparkSession.createDataFrame(list(share.items()), "s_lang string, part int")
    sample = known.join(F.broadcast(shares), F.col("lang") == F.col("s_lang")).filter(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < F.col("part"))
    counted = sample.select("text", "lang").repartition(12).mapInArrow(tidied(count), "key long, n long")  # bounded by max_docs
    table = counted.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full(len(languages) * BUCKETS, SMOOTHING)
    counts[np.asarray(table.column("key"))] += np.asarray(table.column("n"))
    counts = counts.reshape(len(languages), BUCKETS)
    there = sum(rows.values())
    prior = np.log([(rows[x] + 1) / (there + len(languages)) for x in languages])
    return LanguageModel(languages, np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32).T), prior)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score of every row (repeated rows included); null, empty and letterless texts are und with score 0.
    A text_col that is a field of a kept struct ("row.text") crosses to Python with it, once.

    The broadcast is BUCKETS x languages x 4 bytes, at most MATRIX_BYTES a block of languages."""
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(block) for block in model.blocks()]
    small_batches(spark)
    names = list(keep)
    outer, _, inner = text_col.rpartition(".")
    within = names.index(outer) if outer in names else None

    def run(batches):
        parts = [b.value for b in shared]
        for batch in batches:
            column = batch.column("__text") if within is None else pc.struct_field(batch.column(f"__{within}"), inner)
            lengths = pc.fill_null(pc.binary_length(column.cast(pa.large_string())), 0).to_pylist()
            for a, b in slice_bounds(lengths, SLICE_BYTES):
                langs, scores = score_blocks(parts, [t or "" for t in column.slice(a, b - a).to_pylist()])
                columns = [batch.column(f"__{k}").slice(a, b - a) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    text = [] if within is not None else [F.col(text_col).cast("string").alias("__text")]
    return docs.select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(names)), *text).mapInArrow(tidied(run), schema)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def train_on(docs: DataFrame, max_docs: int = MAX_FIT_DOCS) -> LanguageModel:
    """The model of the query: documents that are not held out."""
    return fit(docs.filter(~held_out()), max_docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train_on(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Word vectors cover the whole corpus: every task adds the sparse ternary index vectors of each word's neighbours
into a hashed table (ROWS x DIMS), the tables are summed in two levels, and one table of fixed size is broadcast.
The network is fitted on at most about MAX_FIT_DOCS labelled documents; temperature is set on held-back rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.words import WordSplitter, mix64, run_kinds

ROWS = 8192
DIMS = 64
NONZEROS = 2
REACH = 2
BLOCKS = 64
FAN_IN = 16
HIDDEN = 32
THRESHOLD = 0.3
#: Bound of the fit of the network.
MAX_FIT_DOCS = 8000
_TOKENS = 300_000

_RUNS = WordSplitter(run_kinds(), lower=False)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero entries of each row's index vector, from a hash of the row number."""
    seed = mix64(np.arange(1, ROWS * NONZEROS + 1, dtype=np.uint64)).reshape(ROWS, NONZEROS)
    return (seed % np.uint64(DIMS)).astype(np.int64), np.where(seed >> np.uint64(63), 1.0, -1.0)


def _token_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, rows of the table for their tokens, token bounds), some texts at a time."""
    hashes, bounds = _RUNS(column)
    tokens = (hashes >> np.uint64(64 - 13)).astype(np.int64)
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + _TOKENS, "right")) - 1)
        yield a, b, tokens[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b


def _narrow(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """ROWS x DIMS float32 from every whole text of docs: unit context vector plus unit index vector of each row; exact sums, so reruns agree."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        table = np.zeros(ROWS * DIMS)
        for batch in batches:
            for _, _, tokens, bounds in _token_runs(batch.column("text")):
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for reach in range(1, REACH + 1):
                    same = doc[reach:] == doc[:-reach]
                    left, right = tokens[:-reach][same], tokens[reach:][same]
                    for word, context in ((left, right), (right, left)):
                        for k in range(NONZEROS):
                            table += np.bincount(word * DIMS + place[context, k], sign[context, k], ROWS * DIMS)
        if table.any():
            parts = table.astype("<i4").reshape(BLOCKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "sums"])

    def fold(kind: str):
        def run(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(ROWS * DIMS // BLOCKS, np.int64)
            for batch in batches:
                for raw in batch.column("sums").to_pylist():
                    total += np.frombuffer(raw, kind)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["block", "sums"])

        # the annotations tell Spark to pass batches one by one
        run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
        return run

    parts = _narrow(docs).mapInArrow(gather, "block int, sums binary").withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    level = parts.groupBy("block", "lane").applyInArrow(fold("<i4"), "block int, sums binary")
    rows = level.groupBy("block").applyInArrow(fold("<i8"), "block int, sums binary").collect()  # BLOCKS rows of fixed size
    context = np.zeros((BLOCKS, ROWS * DIMS // BLOCKS))
    for r in rows:
        context[r["block"]] = np.frombuffer(r["sums"], "<i8")
    context = context.reshape(ROWS, DIMS)
    place, sign = index_vectors()
    own = np.zeros((ROWS, DIMS))
    for k in range(NONZEROS):
        np.add.at(own, (np.arange(ROWS), place[:, k]), sign[:, k])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return (unit(context) + unit(own)).astype(np.float32)


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector, its length and the log token count of every text; zeros for a text without tokens."""
    out = np.zeros((len(column), DIMS + 2))
    for a, b, tokens, bounds in _token_runs(column):
        counts = np.diff(bounds)
        some = np.flatnonzero(counts)
        if len(some):
            sums = np.zeros((b - a, DIMS))
            starts = bounds[:-1]
            for c in range(0, len(tokens), _TOKENS):
                stop = min(len(tokens), c + _TOKENS)
                heads = np.unique(np.clip(starts[some], c, stop - 1))
                owner = np.searchsorted(bounds, heads, "right") - 1
                sums[owner] += np.add.reduceat(vectors[tokens[c:stop]], heads - c, axis=0)
            out[a:b, :DIMS] = sums / np.maximum(counts, 1)[:, None]
            out[a:b, DIMS] = np.linalg.norm(out[a:b, :DIMS], axis=1)
            out[a:b, DIMS + 1] = np.log1p(counts)
    return out


class Network:
    """Two layers: tanh units, one logit; probabilities are sigmoid(logit / temperature)."""

    def __init__(self, inputs: int = DIMS + 2, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.w1, self.b1 = rng.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden)
        self.w2, self.b2 = rng.normal(0, hidden**-0.5, hidden), np.zeros(1)
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> Network:
        """Adam on four fifths of the rows; temperature by the likelihood of the rest. No rows or one class: its smoothed rate."""
        if len(y) < 10 or y.min() == y.max():
            self.w2[:] = 0
            self.b2[:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
            return self
        held = np.arange(len(y)) % 5 == 0
        tx, ty = x[~held], y[~held]
        self.mean, self.scale = tx.mean(axis=0), np.maximum(tx.std(axis=0), 1e-6)
        rng, weights = np.random.default_rng(11), [self.w1, self.b1, self.w2, self.b2]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        z = (tx - self.mean) / self.scale
        for _ in range(epochs):
            order = rng.permutation(len(ty))
            for k in range(0, len(order), batch):
                i = order[k : k + batch]
                h = np.tanh(z[i] @ self.w1 + self.b1)
                d = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30))) - ty[i]) / len(i)
                dh = np.outer(d, self.w2) * (1 - h * h)
                grads = [z[i].T @ dh + decay * self.w1, dh.sum(axis=0), h.T @ d + decay * self.w2, d.sum(keepdims=True)]
                step += 1
                for w, g, m, v in zip(weights, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        logit, truth = self.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, np.where(truth > 0, -logit, logit) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self


def _features(docs: DataFrame, vectors) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = pool(batch.column("text"), vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(x.astype("<f8")), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    return docs.mapInArrow(run, "doc_id long, quality int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, vectors, max_docs: int = MAX_FIT_DOCS) -> Network:
    """The network, from about max_docs rows of labels(doc_id, quality), chosen by a hash of the id, and the texts of docs."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    there, million = known.count(), 1_000_000
    part = min(million, max(1, max_docs * million // max(1, there)))
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < part)  # bounded by max_docs
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = _features(_narrow(named, "doc_id", "quality"), vectors).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.asarray([r["x"] for r in rows]).reshape(len(rows), DIMS + 2)
    return Network().fit(x, np.asarray([float(r["quality"]) for r in rows]))


def score(docs: DataFrame, vectors, network: Network) -> DataFrame:
    """doc_id, score of every row, empty and null texts and repeated rows included."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            p = shared.value.probability(pool(batch.column("text"), vectors.value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return _narrow(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, score double")


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    vectors = spark.sparkContext.broadcast(word_vectors(docs))  # ROWS x DIMS x 4 bytes = 2 MB
    scored = score(docs, vectors, fit(docs, labels, vectors))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

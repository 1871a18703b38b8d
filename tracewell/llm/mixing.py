"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Only DataFrame functions. Source totals are pre-aggregated before the shuffle; the seeded order of a
source is cut into 4096 buckets by the leading hex digits of its documents' hash, so that a source
that holds a third of all rows is spread over 4096 window partitions instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm._shared import stage

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
WEIGHT_CYCLE = (1, 2, 3)
SEED = "mix-1"
BUCKET_DIGITS = 3


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources(source, weight, source_size) -> the same with target, whole, goal.

    A source's target is min(max_epochs * size, level * weight), with the level at which targets sum
    to the total size. Clamped sources are a prefix in the order of size / weight, so one ordered pass
    over the (aggregated) source table replaces the repeated resharing of excess, with the same fixed
    point. Empty sources get 0; a table without words gets 0 everywhere.
    """
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    cap = F.col("source_size") * F.lit(max_epochs)
    ranked = (
        sources.withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0).cast("long")))
        .withColumn("weights_left", F.sum("weight").over(rest))
        .withColumn(
            "clamped",
            F.col("cap").cast("double") * F.col("weights_left")
            <= (F.col("total") - F.col("caps_before")).cast("double") * F.col("weight"),
        )
        .withColumn("clamped_caps", F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(everything), F.lit(0).cast("long")))
        .withColumn("open_weight", F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(everything))
    )
    share = (F.col("total") - F.col("clamped_caps")).cast("double") * F.col("weight") / F.col("open_weight")
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return (
        ranked.withColumn("target", target)
        .withColumn("whole", whole)
        .withColumn("goal", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"))
        .select("source", "weight", "source_size", "target", "whole", "goal")
    )


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = WEIGHT_CYCLE) -> DataFrame:
    """Weights 1, 2, 3, repeating, over the distinct sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")).cast("long"))


def draw_of(doc_id, seed: str = SEED) -> F.Column:
    """The seeded place of a document in its source."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(sizes: DataFrame, weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """sizes(doc_id, source, size) -> doc_id, source, size, source_size, target, repeats, taken.

    Every document is taken `whole` times; in the seeded order of its source the documents whose
    middle word lies within the rest of the target are taken once more, so a source's taken words
    miss its target by at most half a document. repeats never exceeds max_epochs. Null sources are a
    source of their own; null ids are hashed as the empty string; repeated rows count as documents of
    their own; null or negative sizes count as 0; an empty table gives no rows. Reruns agree.
    weights(source, weight) overrides the cyclic weights; sources that it lacks get no words.
    """
    rows = stage(
        sizes.select(
            "doc_id",
            "source",
            F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")).alias("size"),
            draw_of(F.col("doc_id"), seed).alias("draw"),
        ).withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS)),
        "mix",
    )
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    totals = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    if weights is None:
        totals = cyclic_weights(totals)
    else:
        mine = totals.alias("t")
        totals = mine.join(weights.alias("w"), F.col("t.source").eqNullSafe(F.col("w.source")), "left").select(
            "t.source", "t.source_size", F.coalesce(F.col("w.weight").cast("long"), F.lit(0).cast("long")).alias("weight")
        )
        totals = totals.withColumn("weight", F.col("weight")).filter("weight > 0")
    plan = water_fill(totals, max_epochs)
    prefix = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(prefix), F.lit(0).cast("long"))).drop("bucket_size")
    b, p = starts.alias("b"), plan.alias("p")
    joined = b.join(p, F.col("b.source").eqNullSafe(F.col("p.source")), "left").select(
        F.col("b.source").alias("of_source"), F.col("b.bucket").alias("of_bucket"), "start",
        F.coalesce("source_size", F.lit(0).cast("long")).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
        F.coalesce("whole", F.lit(0).cast("long")).alias("whole"), F.coalesce("goal", F.lit(0.0)).alias("goal"),
    )
    within = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    out = placed.join(joined, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket")))
    middle = (F.col("start") + F.col("ahead")).cast("double") + F.col("size").cast("double") / 2
    repeats = F.least(F.col("whole") + F.when(middle <= F.col("goal"), 1).otherwise(0), F.lit(max_epochs)).cast("long")
    return out.select(
        "doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """mix() over documents(doc_id, text, source), with a document's size its number of words (null text: 0)."""
    return mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), **options)


def repeat_documents(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """docs with every document as often as the mix takes it; all columns kept.

    The documents taken once more are the first of their source in the seeded order, so one cut a source tells them:
    texts meet a table of one row a source, not the table of all documents. Rows that repeat an id are taken alike."""
    mixed = mix_documents(docs, seed=seed, **options).withColumn("draw", draw_of(F.col("doc_id"), seed))
    cuts = mixed.groupBy("source").agg(
        F.min("repeats").alias("base"), F.max(F.struct("repeats", "draw")).alias("last")
    ).select(F.col("source").alias("__source"), F.col("base").alias("__base"), F.col("last.repeats").alias("__top"), F.col("last.draw").alias("__cut"))
    cuts = stage(cuts, "mix-cuts")
    once_more = (F.col("__top") > F.col("__base")) & (draw_of(F.col("doc_id"), seed) <= F.col("__cut"))
    repeats = F.col("__base") + F.when(once_more, F.col("__top") - F.col("__base")).otherwise(0)
    joined = docs.join(cuts, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__copies", repeats.cast("int"))
    return joined.filter("__copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, (3 * source_size)::BIGINT AS cap FROM src
), ranked AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(cap) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps_before,
    (sum(weight) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights_left
  FROM weighed
), flagged AS (
  SELECT *, cap::DOUBLE * weights_left <= (total - caps_before)::DOUBLE * weight AS clamped FROM ranked
), levels AS (
  SELECT *, coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0)::BIGINT AS clamped_caps,
    (sum(CASE WHEN NOT clamped THEN weight END) OVER ())::BIGINT AS open_weight FROM flagged
), plan_ AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE (total - clamped_caps)::DOUBLE * weight / open_weight END AS target FROM levels
), goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM plan_
), placed AS (
  SELECT r.doc_id, r.size, g.source_size, g.target, g.whole, g.target - (g.whole * g.source_size)::DOUBLE AS goal,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.draw, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM rows_ r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (least(whole + CASE WHEN ahead::DOUBLE + size::DOUBLE / 2 <= goal THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken
FROM placed
"""

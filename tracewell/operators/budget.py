"""Token budgets: exact slices, greedy packing that skips and continues, best-per-key and category-first selection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares of a context package.
SLICE_WEIGHTS = {"summary": 0.10, "graph": 0.25, "source": 0.45, "diagnostics": 0.10, "unresolved": 0.10}


def budget_slices(spark, total: int, weights: Mapping[str, float] = SLICE_WEIGHTS) -> DataFrame:
    """name, tokens: shares that sum exactly to total; what rounding leaves goes to the largest fractions, ties by name."""
    if total <= 0:
        raise ValueError("the budget must be positive")
    rows = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
    exact = rows.withColumn("exact", F.col("weight") * total).withColumn("base", F.floor("exact"))
    place = F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("base")), "name"))
    rest = F.lit(total) - F.sum("base").over(Window.partitionBy())
    return exact.withColumn("tokens", (F.col("base") + (place <= rest).cast("long")).cast("long")).select("name", "tokens")


def greedy_pack(items: DataFrame, bucket: str, order: list[Column], budget: int | str) -> DataFrame:
    """items(bucket, id, cost) -> the packed ones: in order, an item that fits is taken, one that overflows is skipped, later ones may still fit.

    Of items of one cost c only the first budget / c of a bucket can ever be taken, so a bucket is cut to about
    budget * ln(budget) candidates, whatever its size, before they are gathered for the fold. Items without cost are all
    taken; null and negative costs count as 0. A budget given by name is a column with one value a bucket."""
    most = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    costed = items.withColumn("cost", F.greatest(F.coalesce(F.col("cost").cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")))
    free = costed.filter("cost = 0").select(bucket, "id", "cost")
    place = F.row_number().over(Window.partitionBy(bucket, "cost").orderBy(*order))
    able = costed.filter((F.col("cost") > 0) & (F.col("cost") <= most)).withColumn("place_", place).filter(F.col("place_") * F.col("cost") <= most)
    entry = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col("id"), F.col("cost"))
    listed = able.groupBy(bucket).agg(F.array_sort(F.collect_list(entry)).alias("listed"), F.max(most).alias("most_"))
    kind = items.schema["id"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<id:{kind},cost:bigint>>").alias("out"))

    def take(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["cost"] <= F.col("most_")
        row = F.array(F.struct(x["id"].alias("id"), x["cost"].alias("cost")))
        return F.when(fits, F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["out"], row).alias("out"))).otherwise(acc)

    packed = listed.select(bucket, F.explode(F.aggregate("listed", start, take, lambda acc: acc["out"])).alias("x"))
    return packed.select(bucket, "x.id", "x.cost").unionByName(free)


def pack_with_omissions(items: DataFrame, bucket: str, order: list[Column], budget: int | str) -> DataFrame:
    """items with `omitted`: false for the packed ones, true for those that the token budget leaves out. (bucket, id) is a key."""
    packed = greedy_pack(items, bucket, order, budget).select(bucket, "id", F.lit(False).alias("omitted"))
    return items.join(packed, [bucket, "id"], "left").withColumn("omitted", F.coalesce("omitted", F.lit(True)))


def best_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in ascending order of the given columns; pre-aggregated, so a hot key is no hot task."""
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))
    return df.groupBy(key).agg(first.alias("row_")).select(key, "row_.*")


def category_first(df: DataFrame, category: str, score: str, tie: str, cap: int) -> DataFrame:
    """Rank of each item: the best of every category first, then the rest by score; at most cap a category."""
    inside = F.row_number().over(Window.partitionBy(category).orderBy(F.desc(score), tie))
    ranked = df.withColumn("in_category", inside.cast("long")).filter(F.col("in_category") <= cap)
    overall = F.row_number().over(Window.orderBy((F.col("in_category") > 1).cast("int"), F.desc(score), tie))
    return ranked.withColumn("rank", overall.cast("long"))


def decay_score(df: DataFrame, order: Column) -> DataFrame:
    """score = max(1, 100 - place) by the given order."""
    place = F.row_number().over(Window.orderBy(order)) - 1
    return df.withColumn("score", F.greatest(F.lit(1), F.lit(100) - place).cast("long"))

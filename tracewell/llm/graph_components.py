"""Connected components of a link table by alternating large and small stars; every round is a stored table, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._shared import stage

MAX_ROUNDS = 60


def _with_least(edges: DataFrame) -> DataFrame:
    """edges(u, v) with the least neighbour of u, itself included, as m. Both sides of the join come from exchanges of their own, so hubs can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("of"), F.least("u", "low").alias("m"))
    return edges.join(least, F.col("u") == F.col("of")).select("u", "v", "m")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links(a, b: long) -> node, component (least node reachable), for every node of a link between different nodes.

    Null ends and loops are ignored. A star's centre is pre-aggregated (least neighbour) before its edges meet it."""
    edges = stage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v").distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        stars = _with_least(down)
        small = stars.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v")))
        edges = stage(small.filter("u <> v").distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

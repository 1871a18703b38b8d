"""Structured Streaming forms (extensions): micro-batch differences against a table, and windowed event counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.delta import inventory_diff


def event_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """kind, start of the window, n and sum of value of a stream or table of events; late rows beyond the watermark are dropped in streams."""
    timed = events.withWatermark("ts", watermark) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def inventory_step(state_path: str, out_path: str) -> Callable[[DataFrame, int], None]:
    """What is done with micro-batch n of inventories(root, path, hash): its differences from batch n - 1 go to out_path/batch=n. A batch that is tried again
    overwrites its own folders, so nothing is there twice. The inventory before the first batch is empty; later a missing one is an error, for then
    the state was lost."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{state_path}/{number}")
        now = spark.read.schema(batch.schema).parquet(f"{state_path}/{number}")
        before = spark.read.schema(batch.schema).parquet(f"{state_path}/{number - 1}") if number else now.limit(0)
        inventory_diff(before, now).filter("state <> 'unchanged'").write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return step


def inventory_stream(inventories: DataFrame, state_path: str, out_path: str):
    """A writer that compares each micro-batch of a stream of inventories with the one before it."""
    return inventories.writeStream.foreachBatch(inventory_step(state_path, out_path)).option("checkpointLocation", f"{state_path}/checkpoint")

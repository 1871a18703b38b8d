"""Session defaults and table loading shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cpus: str | int = "*", app: str = "tracewell") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    shuffles = str(os.cpu_count() or 8) if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffles)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks for each core where rows are spread.
SPREAD = 4


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: they pass a generator of one row, across which neither filters nor projections are moved."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def spread(df: DataFrame, text: str) -> DataFrame:
    """df dealt out evenly over all cores. A table of few bytes is read by one task however many rows it has; what later steps compute of `text` stays
    behind the exchange, filters too."""
    dealt = df.repartition(SPREAD * df.sparkSession.sparkContext.defaultParallelism)
    return once(dealt.withColumnRenamed(text, f"__{text}"), **{text: F.col(f"__{text}")}).select(*df.columns)


def _shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names (one of our own where it is unset, in tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tracewell-checkpoint-')}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again. Unlike that of a checkpoint its size is known, so rows that meet it need no shuffle where it is small."""
    path = f"{_shared(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Versioned snapshots of units and facts: content diff, invalidation, publication with the pointer written last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import content_hash
from tracewell.operators.delta import inventory_diff
from tracewell.operators.documents import equality_view

#: Parts a root from a path where units are analysed; neither holds it.
_PART = "\x00"


class SnapshotStore:
    """Parquet partitions by snapshot below one folder. A pointer table names the current snapshot; it is appended after
    all data, so readers never see half a publication."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/{table}")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def current(self) -> int:
        """Number of the published snapshot, 0 before the first."""
        return self._read("pointer", "snapshot int").agg(F.coalesce(F.max("snapshot"), F.lit(0))).first()[0]

    def units(self, snapshot: int) -> DataFrame:
        return self._read("units", "root string, path string, hash string, content string, snapshot int").filter(F.col("snapshot") == snapshot).drop("snapshot")

    def facts(self, snapshot: int) -> DataFrame:
        return self._read("facts", "root string, path string, line long, type string, fact string, name string, detail string, snapshot int").filter(F.col("snapshot") == snapshot).drop("snapshot")

    def _publish(self, units: DataFrame, facts: DataFrame, number: int) -> int:
        for name, rows in (("units", units), ("facts", facts)):
            rows.withColumn("snapshot", F.lit(number)).write.mode("append").partitionBy("snapshot").parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(number,)], "snapshot int").coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")
        return number

    @staticmethod
    def _analysed(units: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Facts with root and path; units of two roots may have one path."""
        facts = analyse(units.select(F.concat_ws(_PART, "root", "path").alias("path"), "content"))
        root, path = F.substring_index("path", _PART, 1), F.substring_index("path", _PART, -1)
        return facts.select(root.alias("root"), path.alias("path"), *(c for c in facts.columns if c != "path"))

    def full(self, units: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> int:
        """Analyse all units(root, path, hash, content) and publish."""
        return self._publish(units, self._analysed(units, analyse), self.current() + 1)

    def incremental(self, units: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> int:
        """Analyse what was added or changed, keep the facts of the rest, publish; without any difference nothing is written."""
        base = self.current()
        states = inventory_diff(self.units(base).select("root", "path", "hash"), units.select("root", "path", "hash"))
        if states.filter("state <> 'unchanged'").isEmpty():
            return base
        same = states.filter("state = 'unchanged'").select("root", "path")
        new = states.filter("state in ('added', 'changed')").select("root", "path")
        kept = self.facts(base).join(same, ["root", "path"], "left_semi")
        fresh = self._analysed(units.join(new, ["root", "path"], "left_semi"), analyse)
        return self._publish(units, kept.unionByName(fresh), base + 1)

    def equality(self, snapshot: int) -> DataFrame:
        """name, n_rows, fingerprint of a snapshot's units and facts: equal for snapshots that say the same, however they came about."""
        return equality_view(units=self.units(snapshot).select("root", "path", "hash"), facts=self.facts(snapshot))

    def verify(self, snapshot: int) -> DataFrame:
        """root, path of units whose canonical content no longer has its hash."""
        return self.units(snapshot).filter(content_hash(F.col("content")) != F.col("hash")).select("root", "path")

"""Diagnostic packs: named statements with parameters, run behind the guard, and variants tried in turn."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tracewell.plans.guard import identifier, read_only

PACKS: dict[str, list[tuple[str, str]]] = {
    "orders-overview": [
        ("by-status", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice >= :least GROUP BY o_orderstatus"),
        ("by-priority", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice >= :least GROUP BY o_orderpriority"),
    ],
    "customer-overview": [("by-segment", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal >= :least GROUP BY c_mktsegment")],
}


def run_pack(spark: SparkSession, name: str, args: Mapping, max_rows: int | None = None) -> dict[str, DataFrame]:
    """Step -> rows of a pack; parameters are bound, never spliced."""
    if name not in PACKS:
        raise ValueError(f"no such pack: {name}")
    return {step: read_only(spark, sql, max_rows, dict(args)) for step, sql in PACKS[name]}


def first_that_resolves(spark: SparkSession, variants: Sequence[tuple[str, str]], max_rows: int | None = None) -> tuple[str, DataFrame, list[str]]:
    """(name of the variant, rows, error classes of those before it): the first statement whose tables and columns exist."""
    failed = []
    for name, sql in variants:
        try:
            return name, read_only(spark, sql, max_rows), failed
        except AnalysisException as error:
            failed.append(error.getCondition() or "UNKNOWN")
    raise ValueError(f"no variant resolves: {failed}")


def with_available_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Those of the wanted columns that exist, in order."""
    there = {c.upper(): c for c in df.columns}
    return df.select(*(there[identifier(c)] for c in wanted if identifier(c) in there))

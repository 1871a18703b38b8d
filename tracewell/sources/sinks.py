"""Rows out: delimited text, aligned tables, fingerprinted JSON, portable snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.nested import canonical


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolons, all values quoted, one header per part."""
    df.write.option("sep", ";").option("quoteAll", "true").option("header", "true").csv(path)


def shown(value: Column, kind: str) -> Column:
    """A value as text: binary as a mark, decimals plain, null as empty."""
    text = F.lit("<binary>") if kind == "binary" else value.cast("string")
    return F.coalesce(F.when(value.isNotNull(), text), F.lit(""))


def ascii_table(df: DataFrame, most: int = 50, width: int = 40) -> str:
    """The first rows as an aligned table; long cells end in an ellipsis."""
    cut = lambda s: s if len(s) <= width else s[: width - 1] + chr(0x2026)
    rows = [[cut(c) for c in df.columns]] + [[cut(v) for v in r] for r in df.select(*(shown(F.col(c), k).alias(c) for c, k in df.dtypes)).limit(most).collect()]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    line = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([line(rows[0]), "-+-".join("-" * w for w in widths), *map(line, rows[1:])])


def fingerprinted_json(df: DataFrame) -> DataFrame:
    """json (keys sorted at every depth, nulls left out) and sha256 of each row."""
    return df.select(canonical(F.to_json(F.struct(*sorted(df.columns)))).alias("json")).withColumn("sha256", F.sha2("json", 256))


def export_snapshot(units: DataFrame, path: str) -> DataFrame:
    """One snapshot as Parquet with its manifest of paths and hashes; absolute paths are refused."""
    if not units.filter(F.col("path").rlike(r"^([A-Za-z]:|[/\\])")).isEmpty():
        raise ValueError("a portable snapshot holds relative paths only")
    units.write.parquet(f"{path}/units")
    manifest = units.select("path", "hash")
    manifest.write.json(f"{path}/manifest")
    return manifest


def import_snapshot(spark, path: str) -> DataFrame:
    """Units of an exported snapshot; fails unless each agrees with the manifest."""
    units = spark.read.parquet(f"{path}/units")
    listed = spark.read.schema("path string, hash string").json(f"{path}/manifest")
    if not units.select("path", "hash").exceptAll(listed).isEmpty() or not listed.exceptAll(units.select("path", "hash")).isEmpty():
        raise ValueError("the snapshot differs from its manifest")
    return units

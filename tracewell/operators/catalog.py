"""Catalogue scans over frames of a database catalogue: row estimates, dependents, lookups with a fallback, members, discovery filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.plans.guard import identifier

# Characters of a column pattern, names of source files, parts of the column names that a ticket is likely about.
PATTERN_CHARACTERS = r"^[A-Z0-9_%$#@]+$"
SOURCE_FILES = ("QRPGLESRC", "QCPYSRC", "QCLSRC", "QCLLESRC", "QSQLSRC", "QTBLSRC", "QSRVSRC", "QDDSSRC")
TICKET_FIELDS = ("STATUS", "NR", "DATUM", "USER", "TIME", "ID")


def _upper(c: str | Column) -> Column:
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def row_estimates(tables: DataFrame, partitions: DataFrame) -> DataFrame:
    """tables(schema, table), partitions(schema, table, rows) -> schema, table, estimated_rows (null where the catalogue has none)."""
    known = partitions.groupBy(_upper("schema").alias("schema"), _upper("table").alias("table")).agg(F.sum("rows").cast("long").alias("estimated_rows"))
    return tables.select(_upper("schema").alias("schema"), _upper("table").alias("table")).distinct().join(known, ["schema", "table"], "left")


def dependents(tables: DataFrame, catalog: DataFrame, owner: tuple[str, str], name: tuple[str, str], details: Sequence[str] = ()) -> DataFrame:
    """Rows of a catalogue of triggers or dependent views that belong to the tables: schema, table, object_schema, object_name, details.

    owner and name are the catalogue's column pairs of the table and of the dependent object; all values trimmed and in upper case."""
    asked = tables.select(_upper("schema").alias("schema"), _upper("table").alias("table")).distinct()
    found = catalog.select(_upper(owner[0]).alias("schema"), _upper(owner[1]).alias("table"), _upper(name[0]).alias("object_schema"), _upper(name[1]).alias("object_name"), *(_upper(c).alias(c) for c in details))
    return found.join(asked, ["schema", "table"], "left_semi")


def lookup_tables(requested: DataFrame, catalog: DataFrame, fallback: DataFrame) -> DataFrame:
    """requested(name) met by catalog(schema, table) or, where it has none, by fallback(schema, table): name, schema, table, strategy.

    strategy is CATALOG, FALLBACK or NONE (schema and table null)."""
    asked = requested.select(_upper("name").alias("name")).distinct()
    side = lambda df: df.select(_upper("schema").alias("schema"), _upper("table").alias("table")).distinct()
    first = asked.join(side(catalog), F.col("name") == F.col("table")).withColumn("strategy", F.lit("CATALOG"))
    left = asked.join(first.select("name").distinct(), "name", "left_anti")
    second = left.join(side(fallback), F.col("name") == F.col("table"), "left").withColumn("strategy", F.when(F.col("table").isNull(), "NONE").otherwise("FALLBACK"))
    return first.unionByName(second).select("name", "schema", "table", "strategy")


def members(lines: DataFrame) -> DataFrame:
    """Distinct member names of source lines(member, ...), blank ones left out."""
    return lines.select(F.trim("member").alias("member")).filter("member <> ''").distinct().orderBy("member")


def member_texts(lines: DataFrame) -> DataFrame:
    """lines(member, sequence, data) -> member, content: a member's lines by sequence, without trailing blanks. A member is one record."""
    line = F.struct("sequence", F.rtrim(F.coalesce("data", F.lit(""))).alias("data"))
    listed = lines.groupBy("member").agg(F.array_sort(F.collect_list(line)).alias("listed"))
    return listed.select("member", F.array_join(F.transform("listed", lambda x: x["data"]), "\n").alias("content"))


def source_file_tables(catalog: DataFrame, schemas: Sequence[str], source: bool = True) -> DataFrame:
    """Tables of the schemas that are source files, or all others."""
    named = F.col("table").isin(*SOURCE_FILES)
    return catalog.filter(F.col("schema").isin(*map(identifier, schemas)) & (named if source else ~named))


def columns_like(catalog: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose upper-cased column value is like one of the patterns; a pattern with other characters fails."""
    plain = [p.strip().upper() for p in patterns]
    for p in plain:
        if not p or set(p) - set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_%$#@"):
            raise ValueError(f"not a column pattern: {p!r}")
    return catalog.filter(reduce(lambda a, b: a | b, (F.upper(column).like(p) for p in plain)))


def ticket_columns(catalog: DataFrame, column: str) -> DataFrame:
    return columns_like(catalog, column, [f"%{t}%" for t in TICKET_FIELDS])


def with_keys(df: DataFrame, keys: Mapping[str, object]) -> DataFrame:
    """Rows whose key columns equal the given values, all of them; numbers are compared as numbers, other values as text."""
    tests = [F.col(c) == F.lit(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else F.col(c).cast("string") == F.lit(str(v)) for c, v in keys.items()]
    return df.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table, n_rows of each frame; one aggregate a table."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table"), "n_rows") for n, df in tables.items()))

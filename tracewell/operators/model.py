"""The canonical model over facts: entities with merged evidence, binding summaries, catalogue relations, one-row summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Native file kinds from weakest to strongest.
FILE_KINDS = ("FILE", "DISK", "PRINTER", "WORKSTN")


def entities(facts: DataFrame) -> DataFrame:
    """facts(path, line, fact, name) -> id, type, name, n_evidence, files, first (path and line of the first mention).

    Mentions are counted a file first, so that no task holds all files of a name that is everywhere; evidence itself stays in the facts."""
    named = facts.filter("name is not null and name <> ''").select(F.col("fact").alias("type"), "name", "path", "line")
    each = named.groupBy("type", "name", "path").agg(F.countDistinct("line").alias("lines"), F.min("line").alias("line"))
    # as countDistinct(path, line) does, places without a path don't count
    placed = F.col("path").isNotNull()
    out = each.groupBy("type", "name").agg(F.coalesce(F.sum(F.when(placed, F.col("lines"))), F.lit(0)).alias("n_evidence"), F.count("path").alias("files"), F.min(F.struct("path", "line")).alias("first"))
    return out.withColumn("id", F.concat_ws(":", "type", "name"))


def model_summary(facts: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """One row: number of distinct names of each type, and of files. Names and files are made distinct in one step, two rows a fact."""
    both = F.array(F.struct(F.col("fact").alias("kind"), F.col("name").alias("value")), F.struct(F.lit("").alias("kind"), F.col("path").alias("value")))
    marks = facts.select(F.inline(both)).filter(F.col("kind").isin("", *types) & F.col("value").isNotNull()).distinct()
    count = lambda t: F.count_if(F.col("kind") == t)
    return marks.agg(*(count(t).alias(t.lower()) for t in types), count("").alias("files"))


def strongest_kind(df: DataFrame, key: str, kind: str) -> DataFrame:
    """The kind of highest rank of each key; WORKSTN wins a tie with PRINTER by name."""
    rank = F.array_position(F.array(*map(F.lit, FILE_KINDS)), F.upper(kind))
    return df.groupBy(key).agg(F.max_by(F.upper(F.col(kind)), F.struct(F.least(rank, F.lit(3)), F.upper(kind))).alias("kind"))


def binding_summary(modules: DataFrame, exports: DataFrame) -> DataFrame:
    """modules(program, import), exports(procedure) -> program, n_imports, n_bound, unresolved (sorted)."""
    known = exports.select(F.upper("procedure").alias("e_name")).distinct()
    joined = modules.join(known, F.upper("import") == F.col("e_name"), "left")
    return joined.groupBy("program").agg(
        F.countDistinct("import").alias("n_imports"), F.countDistinct(F.when(F.col("e_name").isNotNull(), F.col("import"))).alias("n_bound"),
        F.array_sort(F.collect_set(F.when(F.col("e_name").isNull(), F.upper("import")))).alias("unresolved"),
    )


def catalog_relations(used: DataFrame, foreign_keys: DataFrame, triggers: DataFrame, derived: DataFrame) -> DataFrame:
    """used(table) with declared foreign_keys(table, target), triggers(table, trigger) and derived(table, object) -> src, dst, type."""

    def of(df: DataFrame, column: str, kind: str) -> DataFrame:
        name: Column = F.upper(F.trim(F.col(column)))
        return df.join(used.select(F.upper("table").alias("u_")).distinct(), F.upper("table") == F.col("u_"), "left_semi").select(F.upper("table").alias("src"), name.alias("dst"), F.lit(kind).alias("type"))

    return of(foreign_keys, "target", "REFERENCES_TABLE").unionByName(of(triggers, "trigger", "HAS_TRIGGER")).unionByName(of(derived, "object", "DERIVES_OBJECT")).distinct()


def co_occurring(matches: DataFrame, key: str, term: str, wanted: list[str]) -> DataFrame:
    """Keys whose matches hold every wanted term."""
    return matches.filter(F.col(term).isin(wanted)).groupBy(key).agg(F.countDistinct(term).alias("n_")).filter(F.col("n_") == len(set(wanted))).select(key)


def corpus_comparison(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(case, category, name) twice -> case, category, missing, unexpected (sorted)."""
    side = lambda df, n: df.groupBy("case", "category").agg(F.collect_set("name").alias(n))
    both = side(expected, "e").join(side(actual, "a"), ["case", "category"], "full_outer")
    none = F.array().cast("array<string>")
    e, a = F.coalesce("e", none), F.coalesce("a", none)
    return both.select("case", "category", F.array_sort(F.array_except(e, a)).alias("missing"), F.array_sort(F.array_except(a, e)).alias("unexpected"))


def valid_facts(facts: DataFrame, now: Column) -> DataFrame:
    """Known facts(updated_at, ttl_days, ...) that have not expired; without a time to live they stay."""
    expires = F.col("updated_at") + F.make_dt_interval(F.col("ttl_days"))
    return facts.filter(F.col("ttl_days").isNull() | (expires > now))

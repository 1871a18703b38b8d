"""Differences between versions: rows, inventories, line texts, sets; invalidation of derived facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _key_text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on trimmed keys: key_text (values between bars, for reading), keys (array, which tells them apart), change
    (INSERTED, UPDATED, DELETED), diffs map<column, struct<before, after>>, before, after.

    A null value equals an empty one. Rows that repeat a key are paired in the order of their values; what one side has more of
    is inserted or deleted."""
    columns = [c for c in after.columns if c not in keys]

    def side(df: DataFrame, name: str) -> DataFrame:
        shown = F.struct(*(F.col(c).cast("string").alias(c) for c in columns))
        rows = df.select(F.array(*(_key_text(F.col(k)) for k in keys)).alias(f"{name}_key"), shown.alias(name))
        place = F.row_number().over(Window.partitionBy(f"{name}_key").orderBy(name))
        return rows.withColumn(f"{name}_place", place)

    same = (F.col("before_key") == F.col("after_key")) & (F.col("before_place") == F.col("after_place"))
    both = side(before, "before").join(side(after, "after"), same, "full_outer").withColumn("keys", F.coalesce("after_key", "before_key"))
    empty = F.lit("")
    entries = F.array_compact(
        F.array(*(
            F.when(F.coalesce(F.col("before")[c], empty) != F.coalesce(F.col("after")[c], empty),
                   F.struct(F.lit(c).alias("column"), F.struct(F.col("before")[c].alias("before"), F.col("after")[c].alias("after")).alias("values")))
            for c in columns
        ))
    )
    change = F.when(F.col("before_key").isNull(), "INSERTED").when(F.col("after_key").isNull(), "DELETED").when(F.size("entries") > 0, "UPDATED")
    return (
        both.withColumn("entries", F.when(F.col("before_key").isNotNull() & F.col("after_key").isNotNull(), entries).otherwise(F.expr("filter(array(named_struct('column', '', 'values', named_struct('before', '', 'after', ''))), x -> false)")))
        .withColumn("change", change)
        .filter("change is not null")
        .select(F.array_join("keys", "|").alias("key_text"), "keys", "change", F.map_from_entries("entries").alias("diffs"), "before", "after")
    )


def _literal(value: Column) -> Column:
    return F.when(value.isNull(), "NULL").when(value.rlike(r"^\s*\d+\s*$"), F.trim(value)).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")))


def rollback_statements(diff: DataFrame, table: str, *key: str) -> DataFrame:
    """key_text, change, statement that undoes each change of a snapshot_diff() by these keys."""
    values = [_literal(F.get("keys", k)) for k in range(len(key))]
    where = F.concat(F.lit(" WHERE "), F.concat_ws(" AND ", *(F.concat(F.lit(f"{c} = "), v) for c, v in zip(key, values, strict=True))))
    sets = F.array_join(F.transform(F.map_entries("diffs"), lambda e: F.concat(e["key"], F.lit(" = "), _literal(e["value"]["before"]))), ", ")
    names = [f.name for f in diff.schema["before"].dataType.fields]
    given = F.array_compact(F.array(*(F.when(F.col("before")[c].isNotNull(), F.struct(F.lit(c).alias("n"), _literal(F.col("before")[c]).alias("v"))) for c in names)))
    listed_or_null = lambda f: F.when(F.size(given) > 0, F.array_join(F.transform(given, lambda e: e[f]), ", "))
    statement = (
        F.when(F.col("change") == "INSERTED", F.concat(F.lit(f"DELETE FROM {table}"), where, F.lit(";")))
        .when(F.col("change") == "UPDATED", F.concat(F.lit(f"UPDATE {table} SET "), sets, where, F.lit(";")))
        .otherwise(F.concat(F.lit(f"INSERT INTO {table} ("), F.concat_ws(", ", F.lit(", ".join(key)), listed_or_null("n")), F.lit(") VALUES ("), F.concat_ws(", ", *values, listed_or_null("v")), F.lit(");")))
    )
    return diff.select("key_text", "change", statement.alias("statement"))


def inventory_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(root, path, hash) twice -> root, path, state: added, changed, deleted, unchanged."""
    b, a = before.alias("b"), after.alias("a")
    both = b.join(a, (F.col("b.root") == F.col("a.root")) & (F.col("b.path") == F.col("a.path")), "full_outer")
    state = F.when(F.col("b.path").isNull(), "added").when(F.col("a.path").isNull(), "deleted").when(F.col("a.hash").eqNullSafe(F.col("b.hash")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("a.root", "b.root").alias("root"), F.coalesce("a.path", "b.path").alias("path"), state.alias("state"))


def keep_valid_facts(facts: DataFrame, links: DataFrame, kept_units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """facts(fact_id, unit) of kept units(unit), and links(src, dst) whose two ends are such facts."""
    valid = facts.join(kept_units, "unit", "left_semi")
    ids = valid.select("fact_id")
    left = links.join(ids.withColumnRenamed("fact_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("fact_id", "dst"), "dst", "left_semi")
    return valid, left


def added_and_removed(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (over columns) that only one side has, with side 'removed' or 'added'; nulls equal each other. Both sides are grouped in one step."""
    both = before.select(*columns, F.lit(True).alias("__old")).unionByName(after.select(*columns, F.lit(False).alias("__old")))
    sides = both.groupBy(*columns).agg(F.bool_or("__old").alias("__old"), F.bool_or(~F.col("__old")).alias("__new"))
    return sides.filter("__old <> __new").select(*columns, F.when(F.col("__old"), "removed").otherwise("added").alias("side"))


def line_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Lines paired by number: keys, line, marker ('+', '-', '~', ' '), before, after."""
    l_, r_ = left.withColumnRenamed("text", "before"), right.withColumnRenamed("text", "after")
    both = l_.join(r_, [*keys, "line"], "full_outer")
    marker = F.when(F.col("before").isNull(), "+").when(F.col("after").isNull(), "-").when(F.col("before") == F.col("after"), " ").otherwise("~")
    return both.select(*keys, "line", marker.alias("marker"), "before", "after")


def fingerprint(rows: DataFrame, columns: list[str], group: str) -> DataFrame:
    """One sha256 a group over its rows' own hashes, independent of order.

    Rows are hashed first and then summed, in five slices of 48 bits of their hashes, so no group is gathered: the group's hash covers the count and
    the five wide sums, which equal multisets share. Nulls count as empty texts."""
    row = F.sha2(F.concat_ws(chr(0), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    hashed = rows.select(group, row.alias("h"))
    part = lambda k: F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")
    sums = hashed.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), *(F.sum(part(k)).alias(f"s{k}") for k in range(5)))
    return sums.select(group, "n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), *(F.col(f"s{k}").cast("string") for k in range(5))), 256).alias("fingerprint"))

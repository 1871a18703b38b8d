"""Operators on tables of nested documents: privacy signals at every path, change sets, and views that compare tables by content."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import nested
from tracewell.functions.text import privacy_codes, privacy_sample
from tracewell.operators.delta import fingerprint


def privacy_signals(documents: DataFrame) -> DataFrame:
    """documents(id, document as JSON) -> id, code, path, sample: every signal that a string shows, at any depth, one row each."""
    texts = nested.text_leaves(documents, "document", ["id"])
    return texts.select("id", F.explode(privacy_codes(F.col("value"))).alias("code"), "path", privacy_sample(F.col("value")).alias("sample"))


# ---------------------------------------------------------------- change sets

_STATE = "struct<items: array<variant>, problem: string, notes: array<string>>"


def _selected(items: Column, where: Mapping[str, Any]) -> Column:
    return F.transform(items, lambda x: nested.holds(x, where))


def _name(item: Column) -> Column:
    """What an item is called: its id, record format name, field type or name, the first that says something."""
    said = [F.when(t != "", t) for t in (nested.shown(nested.at(item, k)) for k in ("id", "record format name", "field type", "name"))]
    return F.coalesce(*said, F.lit("unnamed item"))


def _update(state: Column, operation: Mapping[str, Any], hit: Column) -> tuple[Column, Column]:
    def edited(x: Column) -> Column:
        for path, value in operation.get("set", {}).items():
            x = nested.with_value(x, path, nested.variant(value))
        for path in operation.get("unset", ()):
            x = nested.without_value(x, path)
        return x

    pairs = F.arrays_zip(state["items"].alias("x"), hit.alias("h"))
    items = F.transform(pairs, lambda p: F.when(p["h"], edited(p["x"])).otherwise(p["x"]))
    notes = F.transform(F.filter(pairs, lambda p: p["h"]), lambda p: F.concat(F.lit("updated "), _name(p["x"])))
    return items, notes


def _remove(state: Column, operation: Mapping[str, Any], hit: Column) -> tuple[Column, Column]:
    pairs = F.arrays_zip(state["items"].alias("x"), hit.alias("h"))
    items = F.transform(F.filter(pairs, lambda p: ~p["h"]), lambda p: p["x"])
    return items, F.transform(F.filter(pairs, lambda p: p["h"]), lambda p: F.concat(F.lit("removed "), _name(p["x"])))


def _insert(state: Column, operation: Mapping[str, Any], hit: Column) -> tuple[Column, Column]:
    new = nested.variant(operation["item"])
    last = (F.size(hit) - F.array_position(F.reverse(hit), True) + 1).cast("int")
    tail = F.slice(state["items"], last + 1, F.greatest(F.size(hit) - last, F.lit(0)))
    items = F.concat(F.slice(state["items"], F.lit(1), last), F.array(new), tail)
    return items, F.array(F.concat(F.lit("inserted "), _name(new), F.lit(" after "), _name(F.get(state["items"], last - 1))))


def _column(state: Column, operation: Mapping[str, Any], hit: Column) -> tuple[Column, Column]:
    """The first grid that matches counts one column more, its lists of widths and headings one entry, and the column's item goes to the end."""
    place = (F.array_position(hit, True) - 1).cast("int")
    grid = F.get(state["items"], place)
    number = F.coalesce(F.try_variant_get(grid, "$['number of columns']", "int"), F.lit(0)) + 1

    def grown(x: Column) -> Column:
        x = nested.with_value(x, "number of columns", number.cast("string").cast("variant"))
        for field, key in (("column widths", "width"), ("column headings", "heading")):
            if key in operation:
                old = F.transform(F.filter(F.split(F.coalesce(nested.at(grid, field, "string"), F.lit("")), ","), lambda t: t != ""), lambda t: F.trim(t))
                x = nested.with_value(x, field, F.array_join(F.concat(old, F.array(F.lit(str(operation[key])))), ",").cast("variant"))
        return x

    own = F.coalesce(F.when(nested.at(grid, "id", "string") != "", nested.at(grid, "id", "string")), F.lit(operation["grid"]))
    item = nested.variant({"field type": operation.get("field type", "output field")})
    item = nested.with_value(item, "id", F.concat(F.lit(f"{operation['grid']}_col"), number.cast("string")).cast("variant"))
    item = nested.with_value(nested.with_value(item, "grid", own.cast("variant")), "column", number.cast("string").cast("variant"))
    for path, value in operation.get("set", {}).items():
        item = nested.with_value(item, path, nested.variant(value))
    items = F.concat(F.transform(state["items"], lambda x, i: F.when(i == place, grown(x)).otherwise(x)), F.array(item))
    return items, F.array(F.concat(F.lit("added column "), number.cast("string"), F.lit(f" to {operation['grid']}")))


_EDITS = {"update": _update, "remove": _remove, "insert": _insert, "column": _column}


def apply_changes(documents: DataFrame, operations: Sequence[Mapping[str, Any]]) -> DataFrame:
    """documents(id, document) -> id, document, problem, notes: a change set applied to the list `items` of every document.

    Operations, in order: {"type": "update", "where", "set": {path: value}, "unset": [path]}, {"type": "remove", "where"}, {"type": "insert", "where",
    "item"} (after the last match), {"type": "column", "grid", "width", "heading", "set"}. `where` is as in nested.holds. An operation
    that matches nothing (NO_MATCH), or several items without "multiple": true (SEVERAL_MATCHES), is the document's problem: nothing of the set is
    applied to it. A document without a list of items has an empty one; a text that is no JSON object is NO_OBJECT. Other columns are dropped."""
    for operation in operations:
        if operation.get("type") not in _EDITS:
            raise ValueError(f"unknown operation: {operation.get('type')}")
    empty = F.array().cast("array<variant>")
    none = F.lit(None).cast("string")
    rows = documents.select("id", "document", nested.parsed(F.col("document")).alias("v"))
    start = F.struct(F.coalesce(nested.at(F.col("v"), "items", "array<variant>"), empty).alias("items"), F.when(nested.members(F.col("v")).isNull(), "NO_OBJECT").alias("problem"), F.array().cast("array<string>").alias("notes"))
    rows = rows.withColumn("state", start.cast(_STATE))
    for number, operation in enumerate(operations, 1):  # one projection an operation keeps its expressions small
        kind, state = operation["type"], F.col("state")
        if kind == "column":
            wanted = F.lit(operation["grid"])
            is_grid = lambda x: F.coalesce((nested.at(x, "field type", "string") == "grid") & ((nested.at(x, "record format name", "string") == wanted) | (nested.at(x, "id", "string") == wanted)), F.lit(False))  # noqa: B023, E731
            hit = F.transform(state["items"], is_grid)
        else:
            hit = _selected(state["items"], operation.get("where", {}))
        rows = rows.withColumn("hit", hit)
        n = F.size(F.filter("hit", lambda h: h))
        several = F.lit(kind != "column" and not operation.get("multiple", False))
        wrong = F.when(n == 0, F.lit(f"{number}:NO_MATCH")).when(several & (n > 1), F.lit(f"{number}:SEVERAL_MATCHES"))
        items, notes = _EDITS[kind](state, operation, F.col("hit"))
        problem = F.coalesce(state["problem"], wrong)
        after = F.struct(items.alias("items"), none.alias("problem"), F.concat(state["notes"], notes).alias("notes"))
        before = F.struct(state["items"].alias("items"), problem.alias("problem"), state["notes"].alias("notes"))
        rows = rows.withColumn("state", F.when(problem.isNull(), after).otherwise(before))
    done = nested.with_value(F.col("v"), "items", F.to_variant_object("state.items"))
    sound = F.col("state.problem").isNull()
    return rows.select("id", F.when(sound, F.to_json(done)).otherwise(F.col("document")).alias("document"), F.col("state.problem").alias("problem"), F.when(sound, F.col("state.notes")).otherwise(F.array().cast("array<string>")).alias("notes"))


# ---------------------------------------------------------------- equality


def canonical_rows(df: DataFrame) -> DataFrame:
    """df with json: each row as JSON, keys sorted at every depth of structs, maps and lists. Columns of JSON text stay text."""
    return df.withColumn("json", nested.canonical(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))))))


def equality_view(**tables: DataFrame) -> DataFrame:
    """name, n_rows, fingerprint of each table: equal for tables of equal rows, whatever their order and that of columns and keys. Rows are hashed one by
    one and summed, so nothing is gathered; an empty table has no row."""
    parts = [canonical_rows(df).select(F.lit(name).alias("name"), "json") for name, df in sorted(tables.items())]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return fingerprint(every, ["json"], "name")


def snapshot_view(units: DataFrame, symbols: DataFrame, relationships: DataFrame) -> DataFrame:
    """The equality view of a snapshot: what its units, symbols and relationships say, without when and how they were found."""
    return equality_view(units=units.select("root", "path", "hash"), symbols=symbols.select("id", "name", "kind", "path", "hash"), relationships=relationships.select("id", "src", "dst", "type"))

"""Predicates, walks and edits on nested JSON documents. A document is JSON text; it is read once into a VARIANT, so that what an edit
does not touch keeps its type and value. Texts that are no JSON, or have a key twice, are no documents (null)."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut

OPERATORS = ("$contains", "$matches", "$in", "$exists")
#: Levels of a walk that are planned together.
LEVELS = 12


def parsed(document: Column) -> Column:
    return F.try_parse_json(document)


def json_path(dotted: str) -> str:
    """A dotted path as a JSON path; steps of digits are indexes."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else "['" + p.replace("'", "\\'") + "']" for p in dotted.split(".") if dotted)


def at(value: Column, dotted: str, kind: str = "variant") -> Column:
    """What a VARIANT holds at a dotted path, of one kind; null where there is none or it is of another kind."""
    return F.try_variant_get(value, json_path(dotted), kind)


def shown(value: Column) -> Column:
    """A VARIANT as text: strings as they are, all else as JSON with sorted keys."""
    return F.coalesce(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")), F.to_json(value))


def value_at(document: Column, dotted: str) -> Column:
    """The value at a dotted path as text; null where there is none, and for a JSON null."""
    return let(at(parsed(document), dotted), lambda found: F.when(~F.is_variant_null(found), shown(found)))


def holds(value: Column, where: Mapping[str, Any]) -> Column:
    """Whether a VARIANT meets all of where: a path (loosely equal: 3 and "3" agree, true and "true" too, lists and objects by their JSON), or a path ending
    in $contains, $matches, $in or $exists. A JSON null exists; it equals only null, and matches as an empty text."""
    test = F.lit(True)
    for key, wanted in where.items():
        path, operator = next(((key[: -len(o)].rstrip("."), o) for o in OPERATORS if key.endswith(o)), (key, ""))
        found = at(value, path)
        there, null = found.isNotNull(), F.is_variant_null(found)
        text = shown(found)
        if operator == "$contains":
            one = there & ~null & text.contains(_text(wanted))
        elif operator == "$matches":
            one = F.when(there & ~null, text).otherwise("").rlike(wanted)
        elif operator == "$in":
            one = there & text.isin([_text(w) for w in wanted])
        elif operator == "$exists":
            one = there if wanted else ~there
        elif wanted is None:
            one = there & null
        else:
            one = there & ~null & (text == _text(wanted))
        test = test & F.coalesce(one, F.lit(False))
    return test


def matches(document: Column, where: Mapping[str, Any]) -> Column:
    """holds() of a document's text."""
    return holds(parsed(document), where)


def _text(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def variant(value: Any) -> Column:
    """A Python value as a VARIANT; a VARIANT column stays as it is."""
    return value if isinstance(value, Column) else F.parse_json(F.lit(json.dumps(value)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value written once in the expression."""
    return F.get(F.transform(F.array(value), use), 0)


def members(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def elements(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def with_value(value: Column, dotted: str, new: Column) -> Column:
    """The VARIANT with `new` at a dotted path. Objects that are missing on the way, or are no objects, are made; a step of digits sets a place of a list,
    beyond whose end nulls are filled in."""
    head, _, rest = dotted.partition(".")

    def edit(v: Column) -> Column:
        inner = lambda old: with_value(old, rest, new) if rest else new
        none = F.create_map().cast("map<string,variant>")
        set_ = lambda some: F.to_variant_object(F.map_concat(F.map_filter(some, lambda k, _: k != head), F.create_map(F.lit(head), inner(F.try_element_at(some, F.lit(head))))))
        keyed = let(F.coalesce(members(v), none), set_)
        if not head.isdigit():
            return keyed
        place = int(head)

        def placed(listed: Column) -> Column:
            places = F.sequence(F.lit(0), F.greatest(F.size(listed) - 1, F.lit(place)))
            filled = F.transform(places, lambda i: F.when(i == place, inner(F.get(listed, F.lit(place)))).otherwise(F.coalesce(F.get(listed, i), variant(None))))
            return F.when(listed.isNotNull(), F.to_variant_object(filled)).otherwise(keyed)

        return let(elements(v), placed)

    return let(value, edit)


def without_value(value: Column, dotted: str) -> Column:
    """The VARIANT without what a dotted path names; a place of a list becomes null, so that others keep theirs. Without such a path it stays."""
    head, _, rest = dotted.partition(".")

    def edit(v: Column) -> Column:
        some = members(v)
        there = F.map_contains_key(some, F.lit(head))
        if rest:
            keyed = F.to_variant_object(F.transform_values(some, lambda k, x: F.when(k == head, without_value(x, rest)).otherwise(x)))
        else:
            keyed = F.to_variant_object(F.map_filter(some, lambda k, _: k != head))
        out = F.when(F.coalesce(there, F.lit(False)), keyed)
        if head.isdigit():
            listed, place = elements(v), int(head)
            inner = lambda x: without_value(x, rest) if rest else variant(None)
            out = out.when(F.coalesce(F.size(listed) > place, F.lit(False)), F.to_variant_object(F.transform(listed, lambda x, i: F.when(i == place, inner(x)).otherwise(x))))
        return out.otherwise(v)

    return let(value, edit)


def with_field(document: Column, field: str, value: Column) -> Column:
    """The document with a top-level field set to a text; other fields keep their types."""
    set_ = F.when(value.isNotNull(), value.cast("string").cast("variant")).otherwise(variant(None))
    own = lambda v: F.to_variant_object(F.map_concat(F.map_filter(members(v), lambda k, _: k != field), F.create_map(F.lit(field), set_)))
    return F.to_json(let(parsed(document), own))


def without_field(document: Column, field: str) -> Column:
    return F.to_json(let(parsed(document), lambda v: F.to_variant_object(F.map_filter(members(v), lambda k, _: k != field))))


def flattened(document: Column) -> Column:
    """array<struct<path, value>> of top-level fields, values as text."""
    entries = F.map_entries(members(parsed(document)))
    return F.transform(entries, lambda e: F.struct(F.concat(F.lit("$."), e["key"]).alias("path"), F.when(~F.is_variant_null(e["value"]), shown(e["value"])).alias("value")))


def canonical(document: Column) -> Column:
    """The document's JSON with keys sorted at every depth and numbers in one form; null where it is no document."""
    return F.to_json(parsed(document))


def depth(document: Column) -> Column:
    """How deep brackets nest in a document's text, outside strings."""
    bare = F.regexp_replace(F.regexp_replace(document, r'\\.', ""), '"[^"]*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def leaves(df: DataFrame, document: str, keep: list[str]) -> DataFrame:
    """keep, path, value (VARIANT) of every value of each document that is neither an object nor a list: paths as $.a[0].b.

    One lateral step a level, as many as the deepest document has: the depth is counted first, from the text alone."""
    rows = df.select(*keep, F.lit("$").alias("path"), parsed(F.col(document)).alias("v")).filter("v is not null")
    deepest = df.agg(F.max(depth(F.col(document)))).first()[0] or 0
    for level in range(deepest):
        if level and level % LEVELS == 0:
            rows = cut(rows)
        inner = df.sparkSession.tvf.variant_explode_outer(F.col("v").outer())
        step = F.when(F.col("key").isNotNull(), F.concat("path", F.lit("."), "key")).when(F.col("pos").isNotNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.col("path"))
        rows = rows.select(*(F.col(c).alias(f"k_{c}") for c in keep), "path", "v").lateralJoin(inner)
        rows = rows.select(*(F.col(f"k_{c}").alias(c) for c in keep), step.alias("path"), F.when(F.col("pos").isNull(), F.col("v")).otherwise(F.col("value")).alias("v"))
    return rows.filter(~F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)<")).withColumnRenamed("v", "value")


def text_leaves(df: DataFrame, document: str, keep: list[str]) -> DataFrame:
    """keep, path, value of every string of each document, at any depth."""
    strings = leaves(df, document, keep).filter(F.schema_of_variant("value") == "STRING")
    return strings.select(*keep, "path", F.try_variant_get("value", "$", "string").alias("value"))

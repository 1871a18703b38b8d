"""Masking, pseudonyms, literal redaction, catalogue policies and object resolution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import nested
from tracewell.operators import documents


def masked(df: DataFrame, masks: Mapping[str, str]) -> DataFrame:
    """Values of the named columns replaced where not null; other columns stay. Column names match whatever their case."""
    upper = {k.upper(): v for k, v in masks.items()}
    return df.select(*(F.when(F.col(c).isNotNull(), F.lit(upper[c.upper()])).alias(c) if c.upper() in upper else F.col(c) for c in df.columns))


def merged_masks(everywhere: Sequence[str], rules: Sequence[Mapping], schema: str, table: str, default: str = "MASKED") -> dict[str, str]:
    """Column -> mask value of a table: global columns first, rules that name the table override."""
    out = {c.upper(): default for c in everywhere}
    for rule in rules:
        if rule.get("schema", schema).upper() == schema.upper() and rule.get("table", table).upper() == table.upper():
            out.update({c.upper(): rule.get("value", default) for c in rule["columns"]})
    return out


def policy_plan(requests: DataFrame, allowed: Sequence[str], denied: Sequence[str]) -> DataFrame:
    """requests(table) -> table, status: denied wins over allowed; with an allow list, what it lacks is not allowed."""
    name = F.upper("table")
    status = F.when(name.isin([d.upper() for d in denied]), "denied")
    if allowed:
        status = status.when(~name.isin([a.upper() for a in allowed]), "not-allowed")
    return requests.select("table", status.otherwise("allowed").alias("status"))


def pseudonyms(values: DataFrame, category: str, value: str, seen: str) -> DataFrame:
    """category, value, placeholder CATEGORY_001 ... in first-seen order of distinct values; numbers from 1000 on are whole."""
    firsts = values.groupBy(category, value).agg(F.min(seen).alias("first_"))
    number = F.row_number().over(Window.partitionBy(category).orderBy("first_", value))
    return firsts.select(category, value, F.concat(F.upper(category), F.lit("_"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))).alias("placeholder"))


def redact_literals(text: Column, placeholder: str = "<LITERAL>") -> Column:
    return F.regexp_replace(text, "'(?:[^']|'')*'", f"'{placeholder}'")


def replace_terms(text: Column, pairs: Mapping[str, str]) -> Column:
    """Exact terms replaced, longest first."""
    out = text
    for term in sorted(pairs, key=lambda t: (-len(t), t)):
        out = F.replace(out, F.lit(term), F.lit(pairs[term]))
    return out


def egress_decision(requests: DataFrame, rules: Sequence[Mapping[str, str]]) -> DataFrame:
    """requests(provider, classification, zone) with decision; the first matching rule decides, none denies."""
    decision = None
    for rule in rules:
        test = F.lit(True)
        for k in ("provider", "classification", "zone"):
            if rule.get(k, "*") != "*":
                test = test & (F.col(k) == rule[k])
        decision = F.when(test, rule["decision"]) if decision is None else decision.when(test, rule["decision"])
    return requests.withColumn("decision", F.lit("deny") if decision is None else decision.otherwise("deny"))


def resolve_objects(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """requested(name) against catalog(schema, table, system_schema, system_name): name, status, n_matches, match_type, schema, table.

    Aliases of the catalogue are exploded and met by equality; the best match type is kept of each object."""
    up = lambda c: F.upper(F.trim(c))
    c = catalog.select(up("schema").alias("schema"), up("table").alias("table"), up("system_schema").alias("system_schema"), up("system_name").alias("system_name"))
    forms = (F.concat_ws(".", "schema", "table"), F.concat_ws(".", "system_schema", "system_name"), F.col("table"), F.col("system_name"))
    ranked = F.array(*(F.struct(f.alias("alias"), F.lit(k).alias("rank")) for k, f in enumerate(forms, 1)))
    aliases = c.withColumn("a", F.explode(ranked)).select("schema", "table", "a.alias", "a.rank").filter("alias is not null and alias <> ''")
    asked = requested.select("name", F.regexp_replace(up("name"), "/", ".").alias("key"))
    met = asked.join(aliases, F.col("key") == F.col("alias"), "left").groupBy("name", "schema", "table").agg(F.min("rank").alias("rank"))
    out = met.groupBy("name").agg(F.count("rank").alias("n_matches"), F.min(F.struct("rank", "schema", "table")).alias("best"))
    kinds = F.element_at(F.array(*map(F.lit, ("SQL_QUALIFIED_NAME", "SYSTEM_QUALIFIED_NAME", "SQL_NAME", "SYSTEM_NAME"))), F.col("best.rank"))
    one = F.col("n_matches") == 1
    status = F.when(F.col("n_matches") == 0, "unresolved").when(one, "resolved").otherwise("ambiguous")
    return out.select("name", status.alias("status"), "n_matches", F.when(one, kinds).alias("match_type"), F.when(one, F.col("best.schema")).alias("schema"), F.when(one, F.col("best.table")).alias("table"))


def preferred_schema(candidates: DataFrame, column: str, preference: Sequence[str]) -> DataFrame:
    """The first of the preferred schemas that is there, else the first by name."""
    place = F.array_position(F.array(*map(F.lit, preference)), F.upper(column))
    return candidates.select(column).distinct().orderBy(F.when(place > 0, place).otherwise(len(preference) + 1), column).limit(1)


def first_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate that df has, whatever its case."""
    there = {c.upper(): c for c in df.columns}
    return next((there[c.upper()] for c in candidates if c.upper() in there), None)


def sampled(df: DataFrame, keys: Sequence[str], limit: int = 50, masks: Mapping[str, str] | None = None) -> DataFrame:
    """The first rows by key, masked: the row sample of an export."""
    return masked(df.orderBy(*keys).limit(limit), masks or {})


#: What is refused before its values are looked at, by the kind of envelope.
REFUSED = {"raw-evidence": "RAW_EVIDENCE_NOT_ALLOWED", "sanitized": "SANITIZED_NOT_FINAL"}


def privacy_gate(candidates: DataFrame) -> DataFrame:
    """candidates(id, envelope, document as JSON) -> id, passed, reasons (array<struct<code, path>>, sorted).

    Raw and sanitized envelopes are refused as such, a document that is no JSON object is MALFORMED_FINAL_CATALOG, and every privacy signal of a string at
    any depth is a reason with its path. A null document is malformed; candidates of one id share their reasons."""
    one = lambda code: F.array(F.struct(F.lit(code).alias("code"), F.lit("$").alias("path")))
    whole = nested.members(nested.parsed(F.col("document"))).isNotNull()
    refused = F.when(F.lit(False), one(""))
    for envelope, code in REFUSED.items():
        refused = refused.when(F.col("envelope") == envelope, one(code))
    judged = candidates.select("id", "document", refused.when(~whole, one("MALFORMED_FINAL_CATALOG")).alias("refused"))
    # the reasons of one document are bounded by its strings
    found = documents.privacy_signals(judged.filter("refused is null").select("id", "document")).groupBy("id").agg(F.collect_set(F.struct("code", "path")).alias("found"))
    none = F.array().cast("array<struct<code:string,path:string>>")
    reasons = F.array_sort(F.coalesce("refused", "found", none))
    return judged.join(found, "id", "left").select("id", reasons.alias("reasons")).select("id", (F.size("reasons") == 0).alias("passed"), "reasons")


def safe_fields(fields: Column) -> Column:
    """map<string, string> without values that look like absolute paths (a slash, a drive, two backslashes) and without nulls."""
    return F.map_filter(fields, lambda _, v: v.isNotNull() & ~v.rlike(r"^(?:/|[A-Za-z]:[\\/]|\\\\)"))


def merged_focus(events: DataFrame, key: str, order: str, lists: Sequence[str]) -> DataFrame:
    """The focus of each session: the union of the names that its events list, column by column, sorted; and its last activity."""
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists]
    return events.groupBy(key).agg(F.max(order).alias("last_active"), *sets).orderBy(F.desc("last_active"), key)

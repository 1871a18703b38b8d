"""Symbols of source units and the relationships between them, with provenance: which source, how derived, how sure.

Two passes, as joins. First every unit's program and every declaration become symbols; then each reference is resolved by name, the nearest scope first: its
own unit, then its root, then anywhere (least id within a scope). What no scope knows becomes an UNRESOLVED_SYMBOL of its own. Files, tables, copies and
service programs are one symbol each over all units; their provenance is the first unit (by id, then line) that mentions them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import blocks, source_lines, sqltext
from tracewell.operators.canonical import ranked_resolution

# Symbol kind, derivation and confidence of each kind of mention; relationship type, derivation and confidence of each kind of reference.
DECLARED = {"PROCEDURE": ("PROCEDURE", "VERIFIED", "high"), "PROTOTYPE": ("PROTOTYPE", "VERIFIED", "high"), "STRUCTURE": ("DATA_STRUCTURE", "VERIFIED", "medium")}
SHARED = {"FILE": ("FILE", "INFERRED", "medium"), "TABLE": ("TABLE", "INFERRED", "medium"), "COPY": ("COPY_MEMBER", "VERIFIED", "high"), "SERVICE_PROGRAM": ("SERVICE_PROGRAM", "INFERRED", "medium")}
USES = {"FILE": "FILE_READ", "TABLE": "SQL_REFERENCE", "COPY": "COPY_INCLUDE", "SERVICE_PROGRAM": "SERVICE_PROGRAM_IMPORT"}


@dataclass(frozen=True)
class SymbolGraph:
    symbols: DataFrame
    """id, name, kind, unit, hash, derivation (VERIFIED, INFERRED, UNRESOLVED), confidence, line (first mention), n_places"""
    relationships: DataFrame
    """id, type, src, dst, unit, hash, derivation, confidence"""
    unresolved: DataFrame
    """kind (PROGRAM_CALL, PROCEDURE_CALL), name, src"""


def unit_id() -> Column:
    return F.concat_ws(":", "root", "path")


def _case(column: str, table: dict[str, tuple[str, str, str]], place: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v[place]))), F.col(column))


def symbol_graph(units: DataFrame, mentions: DataFrame) -> SymbolGraph:
    """units(root, path, hash, family) and mentions(root, path, line, kind, name, owner) of kinds PROCEDURE, PROTOTYPE, STRUCTURE, FILE, TABLE, COPY,
    SERVICE_PROGRAM, CALL and PROCEDURE_CALL; owner is the procedure that holds a call, or null.

    Names are compared trimmed and in upper case; mentions without one, of other kinds, or of units that are not there are left out."""
    up = lambda c: F.upper(F.trim(F.col(c)))
    program = up("base")
    named = units.select("root", "path", "hash", "family", unit_id().alias("unit"), F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("base"))
    programs = named.select(
        F.concat(F.lit("sym:program:"), "unit").alias("id"), program.alias("name"), F.when(F.col("family") == "BND", "SERVICE_PROGRAM").otherwise("PROGRAM").alias("kind"), "unit", "hash",
        F.lit("VERIFIED").alias("derivation"), F.lit("high").alias("confidence"), F.lit(None).cast("long").alias("line"), "root",
    )
    known = named.select(F.col("unit").alias("u_unit"), "hash")
    all_ = mentions.filter("trim(name) <> ''").select("root", unit_id().alias("unit"), F.col("line").cast("long").alias("line"), F.upper("kind").alias("kind"), up("name").alias("name"), up("owner").alias("owner"))
    all_ = all_.join(known, F.col("unit") == F.col("u_unit")).drop("u_unit")

    kinds = {"PROCEDURE": "proc", "PROTOTYPE": "proto", "STRUCTURE": "ds", "FILE": "file", "TABLE": "table", "COPY": "copy", "SERVICE_PROGRAM": "srvpgm"}
    short = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("kind"))
    own = all_.filter(F.col("kind").isin(*DECLARED)).withColumn("id", F.concat_ws(":", F.lit("sym"), short, "unit", "name"))
    common = all_.filter(F.col("kind").isin(*SHARED)).withColumn("id", F.concat_ws(":", F.lit("sym"), short, "name"))
    table = {**DECLARED, **SHARED}
    of = lambda df: df.select("id", "name", _case("kind", table, 0).alias("kind"), "unit", "hash", _case("kind", table, 1).alias("derivation"), _case("kind", table, 2).alias("confidence"), "line", "root")

    source = F.concat(F.lit("sym:program:"), "unit")
    calls = all_.filter("kind = 'CALL'")
    to_program = ranked_resolution(calls, programs.filter("kind = 'PROGRAM'").select("id", "name", "root"), "name", [["root"], []])
    procedures = own.filter("kind = 'PROCEDURE'").select("id", "name", "unit", "root").distinct()
    bound = ranked_resolution(all_.filter("kind = 'PROCEDURE_CALL'"), procedures, "name", [["unit"], ["root"], []])
    holders = procedures.select(F.col("unit").alias("h_unit"), F.col("name").alias("h_name"), F.col("id").alias("holder"))
    bound = bound.join(holders, (F.col("unit") == F.col("h_unit")) & (F.col("owner") == F.col("h_name")), "left").withColumn("src", F.coalesce("holder", source))
    lost = lambda df, what: df.withColumn("lost", F.col("found").isNull()).withColumn("dst", F.coalesce("found", F.concat(F.lit(f"sym:unresolved:{what}:"), "name")))
    to_program, bound = lost(to_program.withColumn("src", source), "program"), lost(bound, "proc")
    missing = to_program.unionByName(bound.select(*to_program.columns)).filter("lost")
    unknown = missing.select(F.col("dst").alias("id"), "name", F.lit("UNRESOLVED_SYMBOL").alias("kind"), "unit", "hash", F.lit("UNRESOLVED").alias("derivation"), F.lit("low").alias("confidence"), "line", "root")

    every = programs.unionByName(of(own)).unionByName(of(common)).unionByName(unknown)
    first = F.min_by(F.struct("name", "kind", "unit", "hash", "derivation", "confidence", "line"), F.struct("unit", F.coalesce("line", F.lit(0))))
    symbols = every.groupBy("id").agg(first.alias("s"), F.countDistinct(F.when(F.col("line").isNotNull(), F.struct("unit", "line"))).alias("n_places")).select("id", "s.*", "n_places")

    uses = F.element_at(F.create_map(*(F.lit(x) for kv in USES.items() for x in kv)), F.col("kind"))
    parts = [
        common.select(uses.alias("type"), source.alias("src"), F.col("id").alias("dst"), "unit", "hash", _case("kind", SHARED, 1).alias("derivation"), _case("kind", SHARED, 2).alias("confidence")),
        *(
            df.select(F.when(F.col("lost"), "DYNAMIC_UNRESOLVED_CALL").otherwise(kind).alias("type"), "src", "dst", "unit", "hash", F.when(F.col("lost"), "UNRESOLVED").otherwise("INFERRED").alias("derivation"), F.when(F.col("lost"), "low").otherwise(sure).alias("confidence"))
            for df, kind, sure in ((to_program, "PROGRAM_CALL", "high"), (bound, "BOUND_PROCEDURE_CALL", "medium"))
        ),
    ]
    # a source symbol lies in one unit, so rows of one id are equal
    relationships = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct().select(F.concat_ws("|", F.lit("rel"), "type", "src", "dst").alias("id"), "type", "src", "dst", "unit", "hash", "derivation", "confidence")
    unresolved = missing.select(F.when(F.col("kind") == "CALL", "PROGRAM_CALL").otherwise("PROCEDURE_CALL").alias("kind"), "name", "src").distinct()
    return SymbolGraph(symbols, relationships, unresolved)


def symbol_facts(files: DataFrame) -> DataFrame:
    """files(path, content) -> path, line, type, fact, name, detail: the mentions of program sources in the form of a snapshot store's facts; detail is the owner of a call."""
    facts = source_lines.source_facts(files)
    found = blocks.source_blocks(files)
    inner = found.filter("kind = 'PROCEDURE'").select(F.col("path").alias("b_path"), F.col("name").alias("owner"), "start", "end")
    kept = facts.filter("fact in ('STRUCTURE', 'FILE', 'COPY', 'SERVICE_PROGRAM', 'CALL', 'PROCEDURE_CALL')").join(inner, (F.col("path") == F.col("b_path")) & F.col("line").between(F.col("start"), F.col("end")), "left")
    kind = source_lines.source_type(F.col("path"))
    declared = found.filter("kind in ('PROCEDURE', 'PROTOTYPE')").select("path", F.col("start").alias("line"), kind.alias("type"), F.col("kind").alias("fact"), "name", F.lit(None).cast("string").alias("detail"))
    texts = source_lines.embedded_statements(files).withColumn("text", F.trim(F.regexp_replace("text", r"(?i)^.*?\bexec\s+sql\b|;\s*$", "")))
    tables = sqltext.statement_facts(texts).select("path", F.col("start").alias("line"), kind.alias("type"), F.lit("TABLE").alias("fact"), F.explode("tables").alias("name"), F.lit(None).cast("string").alias("detail"))
    return kept.select("path", "line", "type", "fact", "name", F.col("owner").alias("detail")).unionByName(declared).unionByName(tables)


def graph_of_snapshot(units: DataFrame, facts: DataFrame) -> SymbolGraph:
    """The symbol graph of a snapshot's units(root, path, hash) and facts as symbol_facts gives them. Resolution looks at all facts, so a snapshot that was
    made in steps has the same graph as one made at once."""
    kind = source_lines.source_type(F.col("path"))
    family = F.when(kind.isin("BND", "BINDER", "BNDSRC"), "BND").otherwise(source_lines.source_family(kind))
    return symbol_graph(units.select("root", "path", "hash", family.alias("family")), facts.select("root", "path", "line", F.col("fact").alias("kind"), "name", F.col("detail").alias("owner")))

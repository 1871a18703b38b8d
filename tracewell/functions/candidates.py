"""Candidates for a context: signals of source lines, salience scores, workflow weights, table contexts, search patterns, error states."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import ASCII_EDGE

# Line signals, salience scores (a base, then what each sign adds), workflow weights, table contexts, error states.
CONDITIONAL_LINE = r"(?i)\b(IF|ELSEIF|WHEN|SELECT|MONITOR|DOW|DOU)\b"
ERROR_LINE = r"(?i)\b(ON-ERROR|ROLLBACK|SQLCOD|SQLSTATE|%ERROR|%STATUS|MONITOR)\b"
CONDITIONAL_SALIENCE = (15, {r"\bMONITOR\b": 30, r"\bSELECT\b|\bWHEN\b": 15, r"\bIF\b|\bELSEIF\b|\bDOW\b|\bDOU\b": 10, r"%ERROR|%EOF|%FOUND|SQLCOD|SQLSTATE|\*IN[0-9]{2}": 25})
ERROR_SALIENCE = (35, {r"\bON-ERROR\b": 60, r"\bROLLBACK\b|\bESCAPE\b|\bEXSR\b": 40, r"SQLCOD|SQLSTATE|%ERROR|%STATUS": 35, r"\bMONITOR\b": 20})
CALL_SALIENCE = (20, {"UNRESOLVED": 90, "DYNAMIC": 80, "EXTERNAL": 35, "PROGRAM": 20, "INTERNAL": 10})
FILE_SALIENCE = (20, {"changing": 80, "interactive": 70, "keyed": 15}, 8)
WORKFLOWS = {
    "documentation": {"sql": 1.2, "calls": 1.0, "fileUsage": 1.15, "conditionals": 0.9, "errorPaths": 1.1},
    "errorAnalysis": {"sql": 1.45, "calls": 1.35, "fileUsage": 1.25, "conditionals": 1.05, "errorPaths": 1.7},
    "security": {"sql": 1.5, "calls": 1.6, "fileUsage": 1.3, "conditionals": 1.1, "errorPaths": 1.8},
    "modernization": {"sql": 1.2, "calls": 1.7, "fileUsage": 1.8, "conditionals": 1.0, "errorPaths": 1.0},
}
TABLE_CONTEXTS = (("SET", "WRITES", r"UPDATE\s+"), ("INSERT", "WRITES", r"INSERT\s+INTO\s+"), ("DELETE", "WRITES", r"DELETE\s+FROM\s+"), ("FROM", "READS", r"FROM\s+"), ("JOIN", "READS", r"JOIN\s+"), ("CURSOR", "READS", r"FOR\s+"))
#: Words after which SQL names a table.
TABLE_PLACES = ("FROM", "INTO", "UPDATE", "JOIN")
NOT_TABLES = ("FROM", "INTO", "WHERE")
SQL_LINES = (r"^SELECT\b.*\bFROM\b", r"^INSERT\b.*\bINTO\b", r"^UPDATE\b.*\bSET\b", r"^DELETE\b\s+FROM\b", r"^MERGE\b\s+INTO\b", r"^WITH\b")
ERROR_STATES = {"SQL0204": "42704", "SQL0206": "42703", "SQL0551": "42501"}


def _ascii(pattern: str) -> str:
    """The pattern with word boundaries over ASCII words only."""
    return pattern.replace(r"\b", ASCII_EDGE)


def _added(base: int, parts: list[tuple[Column, int]]) -> Column:
    return reduce(lambda total, part: total + F.when(part[0], part[1]).otherwise(0), parts, F.lit(base)).cast("long")


def line_score(text: Column, weights: tuple[int, dict[str, int]]) -> Column:
    """The base, and what each pattern found in the line (case ignored) adds."""
    return _added(weights[0], [(text.rlike("(?i)" + _ascii(p)), n) for p, n in weights[1].items()])


def call_score(resolution: Column) -> Column:
    base, parts = CALL_SALIENCE
    return _added(base, [(F.coalesce(F.upper(F.trim(resolution)) == k, F.lit(False)), n) for k, n in parts.items()])


def file_score(changing: Column, interactive: Column, keyed: Column, n_formats: Column) -> Column:
    """Flags that are null add nothing."""
    base, parts, each = FILE_SALIENCE
    return (_added(base, [(F.coalesce(c, F.lit(False)), n) for c, n in zip((changing, interactive, keyed), parts.values(), strict=True)]) + F.coalesce(n_formats, F.lit(0)) * each).cast("long")


def line_candidates(files: DataFrame, path: str, content: str) -> DataFrame:
    """path, line, category (conditionals or errorPaths), score, snippet of the lines that show a condition or an error path.

    A line of both kinds gives two rows; empty lines and null contents none."""
    lines = files.select(path, F.posexplode(F.split(content, "\r?\n", -1)).alias("pos", "raw"))
    text = lines.select(path, (F.col("pos") + 1).cast("long").alias("line"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("snippet"))
    s = F.col("snippet")
    kinds = [("conditionals", CONDITIONAL_LINE, CONDITIONAL_SALIENCE), ("errorPaths", ERROR_LINE, ERROR_SALIENCE)]
    found = F.array_compact(F.array(*(F.when(s.rlike(_ascii(p)), F.struct(F.lit(k).alias("category"), line_score(s, w).alias("score"))) for k, p, w in kinds)))
    return text.withColumn("c", F.explode(found)).select(path, "line", "c.category", "c.score", "snippet")


def workflow_score(category: Column, score: Column, workflow: str) -> Column:
    """The score times the workflow's weight of the category (1 where it has none), rounded half up; unknown workflows weigh as documentation."""
    weights = F.create_map(*(F.lit(x) for kv in WORKFLOWS.get(workflow, WORKFLOWS["documentation"]).items() for x in kv))
    return F.floor(F.coalesce(score, F.lit(0)) * F.coalesce(F.element_at(weights, category), F.lit(1.0)) + 0.5).cast("long")


def candidate_order(score: str = "score", file: str = "file", line: str = "line", label: str = "label") -> list[Column]:
    """Greatest score first, then file, line and label; missing values count as 0 and empty."""
    return [F.coalesce(F.col(score), F.lit(0)).desc(), F.coalesce(F.col(file), F.lit("")), F.coalesce(F.col(line), F.lit(0)), F.coalesce(F.col(label), F.lit(""))]


def table_contexts(line: Column) -> Column:
    """array<struct<table, intent, role>>: the first table of each kind of context in a line, without its schema."""
    found = []
    for role, intent, lead in TABLE_CONTEXTS:
        name = F.upper(F.element_at(F.split(F.regexp_extract(line, "(?i)" + _ascii(rf"\b{lead}([A-Za-z0-9_]+[A-Za-z0-9_.]*)\b"), 1), r"\."), -1))
        found.append(F.when((name != "") & ~name.isin(*NOT_TABLES), F.struct(name.alias("table"), F.lit(intent).alias("intent"), F.lit(role).alias("role"))))
    return F.array_compact(F.array(*found))


def search_pattern(term: str | None = None, member: str | None = None, table: str | None = None, case: bool = False) -> str | None:
    """A pattern that finds a member's name standing alone, a table after one of TABLE_PLACES, or the term (a pattern itself). Tables are found in any case."""
    if member:
        alone = rf"(?<![A-Z0-9_]){re.escape(member.upper())}(?![A-Z0-9_])"
        return alone if case else f"(?i){alone}"
    if table:
        return rf"(?i)(?:{'|'.join(TABLE_PLACES)})\s+{re.escape(table.upper())}"
    return (term if case else f"(?i){term}") if term else None


def is_standalone_sql(line: Column) -> Column:
    """Whether a line that no EXEC SQL opens reads like a statement."""
    text = F.upper(F.trim(F.regexp_replace(line, r"\s+", " ")))
    return reduce(lambda a, b: a | b, (text.rlike(_ascii(p)) for p in SQL_LINES))


def error_state(message: Column) -> Column:
    """The SQL state of an error message: the word of five after SQLSTATE (an equals sign or a colon may stand between, or nothing at all), or the state of a code SQL and
    four digits (the code itself where it has none), whichever comes first; else empty."""
    toks = F.regexp_extract_all(F.upper(F.coalesce(message, F.lit(""))), F.lit(r"[A-Z0-9_]+|[^\sA-Z0-9_]"), F.lit(0))
    is_code = lambda w: (F.length(w) == 7) & w.startswith("SQL") & F.substring(w, 4, 4).rlike("^[0-9]+$")
    is_state = lambda w: (F.length(w) == 5) & ~w.contains("_") & w.rlike("^[A-Z0-9]")
    known = F.create_map(*(F.lit(x) for kv in ERROR_STATES.items() for x in kv))

    def found(word: Column, place: Column) -> Column:
        mark = F.coalesce(F.get(toks, place + 1).isin("=", ":"), F.lit(False))
        after = F.get(toks, place + F.when(mark, 2).otherwise(1))
        glued = F.when((F.length(word) == 13) & word.startswith("SQLSTATE"), F.right(word, F.lit(5)))
        return F.when(is_code(word), F.coalesce(F.element_at(known, word), word)).when((word == "SQLSTATE") & is_state(after), after).when(is_state(glued), glued)

    return F.coalesce(F.get(F.array_compact(F.transform(toks, found)), 0), F.lit(""))

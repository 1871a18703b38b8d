"""Risk levels, statement summaries, SQL consistency findings, regression comparison and salience scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of salience scores.
SQL_SALIENCE = {"WRITE": 70, "READ": 30, "CALL": 25, "TRANSACTION": 25}


def level_of_colours(df: DataFrame, group: str, risk: str) -> DataFrame:
    """Counts of green, yellow and red, and the worst colour, per group."""
    n = lambda colour: F.count_if(F.col(risk) == colour)
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"), n("GREEN").alias("green"), n("YELLOW").alias("yellow"), n("RED").alias("red"))
    return out.withColumn("level", F.when(F.col("red") > 0, "RED").when(F.col("yellow") > 0, "YELLOW").otherwise("GREEN"))


def level_of_severities(df: DataFrame, group: str, severity: str) -> DataFrame:
    """HIGH for a CRITICAL finding or more than two HIGH ones, MEDIUM for one or two, else LOW."""
    out = df.groupBy(group).agg(F.count_if(F.col(severity) == "CRITICAL").alias("critical"), F.count_if(F.col(severity) == "HIGH").alias("high"))
    return out.withColumn("level", F.when((F.col("critical") > 0) | (F.col("high") > 2), "HIGH").when(F.col("high") > 0, "MEDIUM").otherwise("LOW"))


def statement_summary(facts: DataFrame, group: str) -> DataFrame:
    """Counts over statement facts: total, reads, writes, dynamic, unresolved, with cursors, distinct host variables."""
    base = facts.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("intent") == "READ").alias("reads"), F.count_if(F.col("intent") == "WRITE").alias("writes"),
        F.count_if("dynamic").alias("dynamic"), F.count_if(F.size("uncertainty") > 0).alias("uncertain"), F.count_if(F.size("cursors") > 0).alias("with_cursor"),
    )
    names = facts.select(F.col(group).alias("g_"), F.explode("host_variables").alias("v")).groupBy("g_").agg(F.countDistinct("v").alias("host_variables"))
    return base.join(names, F.col(group) == F.col("g_"), "left").drop("g_").withColumn("host_variables", F.coalesce("host_variables", F.lit(0).cast("long")))


def cursor_sets(facts: DataFrame) -> DataFrame:
    """name, actions (sorted set) over all cursors."""
    each = facts.select(F.explode("cursors").alias("c")).select("c.name", "c.action")
    return each.groupBy("name").agg(F.array_sort(F.collect_set("action")).alias("actions"))


def merged_statements(facts: DataFrame) -> DataFrame:
    """Equal statements (kind and upper-cased text) as one, with the union of their tables and their number."""
    each = facts.select("kind", F.upper("text").alias("statement"), F.explode_outer("tables").alias("t"), "id")
    return each.groupBy("kind", "statement").agg(F.array_sort(F.collect_set("t")).alias("tables"), F.countDistinct("id").alias("n_evidence"))


def consistency_findings(facts: DataFrame, key: str) -> DataFrame:
    """key, code, severity of rules over statement facts: exclusion without null handling, a table joined twice, a change without
    WHERE, dynamic SQL with host variables."""
    text, upper = F.col("text"), F.upper("text")
    joined = F.transform(F.col("relations.joins"), lambda j: j["table"])
    rules = [
        ("MISSING_NULL_HANDLING", "WARNING", text.contains("<>") & ~upper.rlike(r"IS\s+(NOT\s+)?NULL|COALESCE|IFNULL")),
        ("DUPLICATE_TABLE_JOIN", "WARNING", F.coalesce(F.size(joined) > F.size(F.array_distinct(joined)), F.lit(False))),
        ("MISSING_WHERE_CLAUSE", "CRITICAL", F.col("kind").isin("DELETE", "UPDATE") & ~upper.rlike(r"\bWHERE\b")),
        ("DYNAMIC_SQL_DETECTED", "MEDIUM", (F.col("kind") == "PREPARE") & (F.size("host_variables") > 0)),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, test in rules)))
    return facts.select(key, F.explode(found).alias("f")).select(key, "f.code", "f.severity")


def embedded_findings(facts: DataFrame, key: str) -> DataFrame:
    """Cursors whose select list and FETCH targets differ in number, and repeated host variables: key, code, subject."""
    per = facts.select(key, "kind", "n_columns", F.size("host_variables").cast("long").alias("n_targets"), F.explode("cursors").alias("c")).select("*", "c.name")
    declared = per.filter("kind = 'DECLARE_CURSOR' and n_columns > 0").groupBy("name").agg(F.max("n_columns").alias("selected"))
    fetched = per.filter("kind = 'FETCH'").select(key, "name", "n_targets")
    arity = fetched.join(declared, "name").filter("selected <> n_targets").select(key, F.lit("CURSOR_FETCH_MISMATCH").alias("code"), F.col("name").alias("subject"))
    raw = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)(?:^|[^A-Z0-9_#$@]):([A-Z][A-Z0-9_#$@]*)"), F.lit(1)), F.upper)
    names = facts.select(key, F.explode(raw).alias("subject")).groupBy(key, "subject").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return arity.unionByName(names.select(key, F.lit("DUPLICATE_HOST_VARIABLE").alias("code"), "subject")).distinct()


def pattern_changes(before: DataFrame, after: DataFrame, pattern: str) -> DataFrame:
    """pattern, before, after of pattern frequencies that differ."""
    b, a = (df.groupBy(pattern).agg(F.count(F.lit(1)).alias(n)) for df, n in ((before, "before"), (after, "after")))
    zero = F.lit(0).cast("long")
    both = b.join(a, pattern, "full_outer").select(pattern, F.coalesce("before", zero).alias("before"), F.coalesce("after", zero).alias("after"))
    return both.filter("before <> after")


def sql_salience(intent: Column, kind: Column, dynamic: Column, unresolved: Column, n_uncertain: Column, n_hosts: Column) -> Column:
    by_intent = reduce(lambda c, kv: c.when(intent == kv[0], kv[1]), list(SQL_SALIENCE.items())[1:], F.when(intent == "WRITE", SQL_SALIENCE["WRITE"])).otherwise(0)
    add = lambda test, n: F.when(test, n).otherwise(0)
    return (F.lit(20) + by_intent + add(dynamic, 85) + add(unresolved, 80) + add(n_uncertain > 0, 25) + add(n_hosts > 0, 10) + add(kind.isin("MERGE", "INSERT", "UPDATE", "DELETE"), 20)).cast("long")


def entity_scores(refs: DataFrame, entity: str, evidence: str, score: str, primary: str) -> DataFrame:
    """5 an evidence, half of each reference's score (10 at least), 30 where primary."""
    half = F.greatest(F.lit(10), F.floor(F.col(score) / 2))
    return refs.groupBy(entity).agg((F.sum(evidence) * 5 + F.sum(half) + F.when(F.bool_or(primary), 30).otherwise(0)).cast("long").alias("score"))


def severity_band(kind: Column, severity: Column, band: str) -> Column:
    """Log rows of a band: ERROR, WARNING or INFO."""
    level = F.coalesce(severity, F.lit(0))
    if band == "ERROR":
        return kind.isin("ESCAPE", "INQUIRY", "NOTIFY") | (level >= 30)
    if band == "WARNING":
        return level.between(1, 29)
    if band == "INFO":
        return (level == 0) | kind.isin("INFORMATIONAL", "COMPLETION", "DIAGNOSTIC", "SENDER", "REQUEST", "REPLY")
    raise ValueError(f"no such band: {band}")

"""Queries of nested documents, the canonical model and diagnostic packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import nested
from tracewell.functions.source_lines import source_facts
from tracewell.operators import model, search
from tracewell.plans import packs, q_source
from tracewell.session import table


def json_predicates(spark, d):
    e = table(spark, d, "events")
    return e.filter(nested.matches(F.col("props"), {"k.$exists": True, "k.$matches": "^[0-4]"})).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def json_edit(spark, d):
    edited = nested.with_field(F.col("props"), "tag", F.col("event_type"))
    left = F.size(nested.flattened(nested.without_field(edited, "k"))).cast("long")
    return table(spark, d, "events").select("event_id", nested.value_at(edited, "tag").alias("tag"), nested.value_at(edited, "k").alias("k"), left.alias("n_left"))


def entity_model(spark, d):
    facts = source_facts(q_source._files(spark, d)).filter("fact in ('FILE', 'CALL', 'COPY')")
    return model.entities(facts).select("id", "n_evidence", "files", F.col("first.path").alias("first_path"), F.col("first.line").alias("first_line"))


def model_summary(spark, d):
    return model.model_summary(source_facts(q_source._files(spark, d)), ("FILE", "CALL", "COPY", "PROCEDURE", "BINDING_DIRECTORY"))


def strongest_kinds(spark, d):
    kinds = table(spark, d, "orders").select("o_custkey", F.element_at(F.array(*map(F.lit, model.FILE_KINDS)), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("kind"))
    return model.strongest_kind(kinds, "o_custkey", "kind")


def binding_summary(spark, d):
    """Exports from every part: their 21 names leave nine imports unresolved."""
    modules = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("program"), F.concat(F.lit("p"), F.col("l_partkey") % 30).alias("import"))
    exports = table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey") % 21).alias("procedure"))
    return model.binding_summary(modules, exports).withColumn("unresolved", F.array_join("unresolved", ","))


def catalog_relations(spark, d):
    cust = table(spark, d, "customer")
    used = cust.filter("c_custkey % 2 = 0").select(F.concat(F.lit("T"), F.col("c_custkey") % 50).alias("table"))
    keys = cust.select(F.concat(F.lit("t"), F.col("c_custkey") % 50).alias("table"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("target"))
    trig = cust.filter("c_custkey % 10 = 0").select(F.concat(F.lit("T"), F.col("c_custkey") % 50).alias("table"), F.lit("trg").alias("trigger"))
    views = cust.filter("c_custkey % 15 = 0").select(F.concat(F.lit("T"), F.col("c_custkey") % 50).alias("table"), F.lit("v1").alias("object"))
    return model.catalog_relations(used, keys, trig, views)


def co_occurrence(spark, d):
    lines = search.text_lines(table(spark, d, "documents"), "doc_id", "text")
    return model.co_occurring(search.line_matches(lines, "doc_id", ["the", "license", "of"]), "doc_id", "term", ["license", "of"])


def corpus_comparison(spark, d):
    li = table(spark, d, "lineitem")
    of = lambda flag: li.filter(F.col("l_returnflag") == flag).select((F.col("l_suppkey") % 10).alias("case"), F.col("l_linestatus").alias("category"), F.concat(F.lit("N"), F.col("l_partkey") % 40).alias("name"))
    out = model.corpus_comparison(of("A"), of("R"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("missing", "unexpected")})


def diagnostic_pack(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    steps = packs.run_pack(spark, "orders-overview", {"least": 1000.0})
    parts = [df.select(F.lit(step).alias("step"), F.col(df.columns[0]).alias("value"), "n") for step, df in steps.items()]
    return parts[0].unionByName(parts[1])


def adaptive_variant(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("nation")
    name, df, failed = packs.first_that_resolves(spark, [("new", "SELECT nation_name AS name FROM nation"), ("old", "SELECT n_name AS name FROM nation")])
    return df.select("name", F.lit(name).alias("variant"), F.lit(len(failed)).cast("long").alias("n_failed"))


def known_facts(spark, d):
    facts = table(spark, d, "events").select("event_id", F.col("ts").alias("updated_at"), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 20).cast("int")).alias("ttl_days"))
    latest = facts.agg(F.max("updated_at").alias("now"))  # one row
    return model.valid_facts(facts.crossJoin(latest), F.col("now")).groupBy(F.col("ttl_days").isNull().alias("endless")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (json_predicates, json_edit, entity_model, model_summary, strongest_kinds, binding_summary, catalog_relations, co_occurrence, corpus_comparison, diagnostic_pack, adaptive_variant, known_facts)}

_K = "json_extract_string(props, '$.k')"
ORACLES = {
    "json_predicates": f"SELECT event_type, count(*) AS n FROM events WHERE {_K} IS NOT NULL AND regexp_matches({_K}, '^[0-4]') GROUP BY 1",
    "json_edit": f"SELECT event_id, event_type AS tag, {_K} AS k, 1::BIGINT AS n_left FROM events",
    "entity_model": """WITH f AS (SELECT 'FILE:FILE' || (c_custkey % 7) AS id, c_custkey AS k, 3 AS line FROM customer UNION ALL SELECT 'COPY:QRPGLESRC,CPY' || (c_custkey % 3), c_custkey, 4 FROM customer UNION ALL SELECT 'CALL:PGM' || (c_custkey * 7 % 100), c_custkey, 9 FROM customer)
SELECT id, count(*) AS n_evidence, count(*) AS files, min('src/P' || k || '.rpgle') AS first_path, min(line)::BIGINT AS first_line FROM f GROUP BY id""",
    "model_summary": "SELECT count(DISTINCT c_custkey % 7) AS file, count(DISTINCT c_custkey * 7 % 100) AS call, count(DISTINCT c_custkey % 3) AS copy, 1::BIGINT AS procedure, count(DISTINCT c_nationkey) AS binding_directory, count(*) AS files FROM customer",
    "strongest_kinds": "SELECT o_custkey, ['FILE', 'DISK', 'PRINTER', 'WORKSTN'][max(o_orderkey % 4)::INT + 1] AS kind FROM orders GROUP BY 1",
    "binding_summary": """WITH e AS (SELECT DISTINCT p_partkey % 21 AS k FROM part), i AS (SELECT DISTINCT l_suppkey AS program, l_partkey % 30 AS k FROM lineitem)
SELECT program, count(*) AS n_imports, count(e.k) AS n_bound, coalesce(string_agg(CASE WHEN e.k IS NULL THEN 'P' || i.k END, ',' ORDER BY 'P' || i.k), '') AS unresolved FROM i LEFT JOIN e ON e.k = i.k GROUP BY 1""",
    "catalog_relations": """WITH u AS (SELECT DISTINCT 'T' || (c_custkey % 50) AS t FROM customer WHERE c_custkey % 2 = 0)
SELECT 'T' || (c_custkey % 50) AS src, 'N' || c_nationkey AS dst, 'REFERENCES_TABLE' AS type FROM customer WHERE 'T' || (c_custkey % 50) IN (SELECT t FROM u)
UNION SELECT 'T' || (c_custkey % 50), 'TRG', 'HAS_TRIGGER' FROM customer WHERE c_custkey % 10 = 0 AND 'T' || (c_custkey % 50) IN (SELECT t FROM u)
UNION SELECT 'T' || (c_custkey % 50), 'V1', 'DERIVES_OBJECT' FROM customer WHERE c_custkey % 15 = 0 AND 'T' || (c_custkey % 50) IN (SELECT t FROM u)""",
    "co_occurrence": "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'of')",
    "corpus_comparison": """WITH n AS (SELECT l_suppkey % 10 AS "case", l_linestatus AS category, 'N' || (l_partkey % 40) AS name, bool_or(l_returnflag = 'A') AS e, bool_or(l_returnflag = 'R') AS a FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2, 3)
SELECT "case", category, coalesce(string_agg(CASE WHEN e AND NOT a THEN name END, ',' ORDER BY name), '') AS missing, coalesce(string_agg(CASE WHEN a AND NOT e THEN name END, ',' ORDER BY name), '') AS unexpected FROM n GROUP BY 1, 2""",
    "diagnostic_pack": "SELECT 'by-status' AS step, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_totalprice >= 1000 GROUP BY 2 UNION ALL SELECT 'by-priority', o_orderpriority, count(*) FROM orders WHERE o_totalprice >= 1000 GROUP BY 2",
    "adaptive_variant": "SELECT n_name AS name, 'old' AS variant, 1::BIGINT AS n_failed FROM nation",
    "known_facts": "WITH f AS (SELECT ts, CASE WHEN event_id % 3 > 0 THEN (event_id % 20)::INT END AS ttl FROM events) SELECT ttl IS NULL AS endless, count(*) AS n FROM f WHERE ttl IS NULL OR ts + ttl * INTERVAL 1 DAY > (SELECT max(ts) FROM events) GROUP BY 1",
}

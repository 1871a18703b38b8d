"""Queries of statement text, risk, governance, aggregates and guarded SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import sqltext as S
from tracewell.operators import govern, risk
from tracewell.plans import guard
from tracewell.session import table

#: A statement of each part row; the same text builds the corpus in both engines.
_STATEMENT = """CASE CAST(p_partkey % 14 AS INT)
WHEN 0 THEN concat('SELECT A, B, COUNT(*) FROM APP.', upper(replace(p_brand, '#', '')), ' C INNER JOIN LIB/ITEMS I ON C.ID = I.ID WHERE C.X = :KEY', CAST(p_size AS VARCHAR(9)), ' AND I.Y <> 3')
WHEN 1 THEN concat('INSERT INTO APP.LOG', CAST(p_size AS VARCHAR(9)), ' VALUES (:ID, :TXT)')
WHEN 2 THEN concat('UPDATE STOCK', CAST(p_size AS VARCHAR(9)), ' SET Q = Q - 1')
WHEN 3 THEN concat('DELETE FROM APP.OLD WHERE D < :CUT AND K = ', CAST(p_partkey AS VARCHAR(9)))
WHEN 4 THEN concat('DECLARE C', CAST(p_size AS VARCHAR(9)), ' CURSOR FOR SELECT A, B FROM APP.ORD LEFT OUTER JOIN CUST ON ORD.C = CUST.C')
WHEN 5 THEN concat('OPEN C', CAST(p_size AS VARCHAR(9)))
WHEN 6 THEN concat('FETCH NEXT FROM C', CAST(p_size AS VARCHAR(9)), ' INTO :A, :B, :D')
WHEN 7 THEN concat('CLOSE C', CAST(p_size AS VARCHAR(9)))
WHEN 8 THEN 'PREPARE S1 FROM :STMT'
WHEN 9 THEN 'EXEC SQL COMMIT'
WHEN 10 THEN 'CALL APP.POST(:ID)'
WHEN 11 THEN 'SELECT A FROM T1, T2 WHERE (A = 1 OR B = 2)'
WHEN 12 THEN 'MERGE INTO APP.STOCK USING NEWS ON A = B'
ELSE concat('LOCK TABLE T', CAST(p_size AS VARCHAR(9))) END"""


def _corpus(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey AS id", "p_brand AS program", f"{_STATEMENT} AS text")


def _facts(spark, d):
    return S.statement_facts(_corpus(spark, d))


def statement_facts(spark, d):
    joined = lambda c: F.array_join(c, ",")
    return _facts(spark, d).select(
        "id", "kind", "intent", joined("tables").alias("tables"), joined("host_variables").alias("hosts"), "dynamic", "unqualified",
        joined(F.transform("cursors", lambda c: F.concat(c["name"], F.lit(":"), c["action"]))).alias("cursors"), joined("uncertainty").alias("uncertainty"), "n_columns",
    )


def statement_relations(spark, d):
    r = F.col("relations")
    joins = F.array_join(F.transform(r["joins"], lambda j: F.concat_ws(" ", j["join_type"], j["table"], j["alias"], j["condition"])), "; ")
    return _facts(spark, d).filter(S.has_relations(F.col("kind"), F.col("dynamic"))).select("id", r["driver"].alias("driver"), joins.alias("joins"), F.array_join(r["filters"], "; ").alias("filters"), r["confidence"].alias("confidence"), F.array_join(r["uncertainty"], ",").alias("marks"))


def statement_summary(spark, d):
    return risk.statement_summary(_facts(spark, d), "program")


def cursor_sets(spark, d):
    return risk.cursor_sets(_facts(spark, d)).withColumn("actions", F.array_join("actions", ","))


def merged_statements(spark, d):
    return risk.merged_statements(_facts(spark, d)).withColumn("tables", F.array_join("tables", ","))


def table_usage(spark, d):
    each = _facts(spark, d).select("id", F.explode("tables").alias("table"), "intent")
    return each.groupBy("table").agg(F.count(F.lit(1)).alias("n_statements"), F.bool_or(F.col("intent") == "READ").alias("is_read"), F.bool_or(F.col("intent") == "WRITE").alias("is_written"))


def statement_risk(spark, d):
    scored = _facts(spark, d).withColumn("r", S.statement_risk(F.col("kind"), F.col("intent"), F.lit(False), F.array_contains("tables", "STOCK"), F.col("program") == "Brand#1"))
    return risk.level_of_colours(scored.withColumn("risk", F.col("r.risk")), "program", "risk")


def consistency_findings(spark, d):
    return risk.consistency_findings(_facts(spark, d), "id")


def finding_levels(spark, d):
    facts = _facts(spark, d)
    return risk.level_of_severities(risk.consistency_findings(facts, "program"), "program", "severity")


def embedded_findings(spark, d):
    return risk.embedded_findings(_facts(spark, d), "id")


def salience_scores(spark, d):
    c = F.col
    return _facts(spark, d).select("id", risk.sql_salience(c("intent"), c("kind"), c("dynamic"), F.size("tables") == 0, F.size("uncertainty"), F.size("host_variables")).alias("score"))


def filter_changes(spark, d):
    facts = _facts(spark, d).withColumn("pattern", F.explode("relations.filters"))
    return risk.pattern_changes(facts.filter("id % 2 = 0"), facts.filter("id % 2 = 1"), "pattern")


def entity_scores(spark, d):
    refs = table(spark, d, "lineitem").select("l_suppkey", F.lit(1).alias("evidence"), F.col("l_linenumber").alias("score"), (F.col("l_quantity") > 49).alias("main"))
    return risk.entity_scores(refs, "l_suppkey", "evidence", "score", "main")


def severity_bands(spark, d):
    rows = table(spark, d, "events").select(F.upper("event_type").alias("kind"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 41).alias("severity"))
    bands = [rows.filter(risk.severity_band(F.col("kind"), F.col("severity"), b)).agg(F.lit(b).alias("band"), F.count(F.lit(1)).alias("n")) for b in ("ERROR", "WARNING", "INFO")]
    return bands[0].unionByName(bands[1]).unionByName(bands[2])


def event_flags(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("value") > 50).alias("any_large"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_kind"))


def message_summary(spark, d):
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("event_type").alias("n_kinds"), (F.count(F.lit(1)) >= 200).alias("limit_reached"))


def masked_customers(spark, d):
    masks = govern.merged_masks(["C_NAME"], [{"table": "customer", "columns": ["c_mktsegment"], "value": "SEGMENT"}], "app", "customer")
    return govern.masked(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), masks)


def policy_plan(spark, d):
    return govern.policy_plan(table(spark, d, "part").select(F.col("p_brand").alias("table")).distinct(), [f"Brand#{k}" for k in range(1, 20)], ["brand#3", "BRAND#11"])


def pseudonyms(spark, d):
    return govern.pseudonyms(table(spark, d, "part").select(F.lit("type").alias("category"), F.col("p_type").alias("value"), F.col("p_partkey").alias("seen")), "category", "value", "seen")


def redacted_text(spark, d):
    t = F.concat(F.col("text"), F.lit(" NOTE 'it''s' X"))
    return _corpus(spark, d).select("id", govern.replace_terms(govern.redact_literals(t), {"APP": "SCHEMA_001", "APP.LOG": "TABLE_001"}).alias("text"))


def egress_plan(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_orderstatus").alias("provider"), F.substring("o_orderpriority", 1, 1).alias("classification"), F.lit("eu").alias("zone")).distinct()
    return govern.egress_decision(asked, [{"provider": "F", "classification": "1", "decision": "deny"}, {"provider": "F", "decision": "allow"}, {"classification": "2", "zone": "eu", "decision": "allow"}])


_CATALOG = "SELECT 'APP' AS schema, upper(n_name) AS table, 'APPLIB' AS system_schema, concat('N', CAST(n_nationkey AS VARCHAR(9))) AS system_name FROM nation UNION ALL SELECT concat('S', CAST(r_regionkey AS VARCHAR(9))), 'SHARED', concat('L', CAST(r_regionkey AS VARCHAR(9))), concat('R', CAST(r_regionkey AS VARCHAR(9))) FROM region"
_REQUESTED = "SELECT concat('APP.', n_name) AS name FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT concat('applib/n', CAST(n_nationkey AS VARCHAR(9))) FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT lower(n_name) FROM nation WHERE n_nationkey % 3 = 2 UNION ALL SELECT 'shared' UNION ALL SELECT 'R2' UNION ALL SELECT 'NOTHING'"


def resolve_objects(spark, d):
    for name in ("nation", "region"):
        table(spark, d, name).createOrReplaceTempView(name)
    return govern.resolve_objects(spark.sql(_REQUESTED), spark.sql(_CATALOG.replace("AS table", "AS `table`")))


def preferred_schema(spark, d):
    return govern.preferred_schema(table(spark, d, "customer").select(F.col("c_mktsegment").alias("schema")), "schema", ["NOWHERE", "MACHINERY", "BUILDING"])


def row_sample(spark, d):
    return govern.sampled(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_custkey"], 50, {"c_name": "MASKED"})


def guarded_sql(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return guard.read_only(spark, "-- totals\nSELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_discount >= :least GROUP BY l_returnflag, l_linestatus", args={"least": 0.05})


def page_of_orders(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    _, token = guard.page(orders, ["o_orderkey"], "orders", None, 50)
    return guard.page(orders, ["o_orderkey"], "orders", token, 50)[0]


def column_like(spark, d):
    return table(spark, d, "part").filter(F.upper("p_type").like("%E%") & (F.col("p_size") == 7)).select("p_partkey", "p_type", "p_size")


QUERIES = {f.__name__: f for f in (statement_facts, statement_relations, statement_summary, cursor_sets, merged_statements, table_usage, statement_risk, consistency_findings, finding_levels, embedded_findings, salience_scores, filter_changes, entity_scores, severity_bands, event_flags, message_summary, masked_customers, policy_plan, pseudonyms, redacted_text, egress_plan, resolve_objects, preferred_schema, row_sample, guarded_sql, page_of_orders, column_like)}

_C = f"c AS (SELECT p_partkey AS id, p_brand AS program, p_partkey % 14 AS m, p_size AS z, {_STATEMENT} AS text, upper(replace(p_brand, '#', '')) AS b FROM part)"
_F = _C + """, f AS (SELECT *,
  CASE m WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' WHEN 3 THEN 'DELETE' WHEN 4 THEN 'DECLARE_CURSOR' WHEN 5 THEN 'OPEN_CURSOR' WHEN 6 THEN 'FETCH' WHEN 7 THEN 'CLOSE_CURSOR' WHEN 8 THEN 'PREPARE' WHEN 9 THEN 'COMMIT' WHEN 10 THEN 'CALL' WHEN 11 THEN 'SELECT' WHEN 12 THEN 'MERGE' ELSE 'OTHER' END AS kind,
  CASE WHEN m IN (0, 4, 6, 11) THEN 'READ' WHEN m IN (1, 2, 3, 12) THEN 'WRITE' WHEN m IN (5, 7) THEN 'CURSOR' WHEN m = 9 THEN 'TRANSACTION' WHEN m = 10 THEN 'CALL' ELSE 'OTHER' END AS intent,
  CASE m WHEN 0 THEN b || ',ITEMS' WHEN 1 THEN 'LOG' || z WHEN 2 THEN 'STOCK' || z WHEN 3 THEN 'OLD' WHEN 4 THEN 'CUST,ORD' WHEN 6 THEN 'C' || z WHEN 11 THEN 'T1' WHEN 12 THEN 'STOCK' ELSE '' END AS tables,
  CASE m WHEN 0 THEN 'KEY' || z WHEN 1 THEN 'ID,TXT' WHEN 3 THEN 'CUT' WHEN 6 THEN 'A,B,D' WHEN 8 THEN 'STMT' WHEN 10 THEN 'ID' ELSE '' END AS hosts,
  m = 8 AS dynamic, m IN (2, 4, 6, 11) AS unqualified,
  CASE m WHEN 4 THEN 'C' || z || ':DECLARE' WHEN 5 THEN 'C' || z || ':OPEN' WHEN 6 THEN 'C' || z || ':FETCH' WHEN 7 THEN 'C' || z || ':CLOSE' ELSE '' END AS cursors,
  CASE m WHEN 2 THEN 'UNRESOLVED_LIBRARY' WHEN 4 THEN 'UNRESOLVED_LIBRARY' WHEN 6 THEN 'UNRESOLVED_LIBRARY' WHEN 8 THEN 'DYNAMIC_SQL' WHEN 11 THEN 'UNRESOLVED_LIBRARY' WHEN 13 THEN 'UNKNOWN_STATEMENT_TYPE' ELSE '' END AS uncertainty,
  CASE m WHEN 0 THEN 3 WHEN 4 THEN 2 WHEN 11 THEN 1 ELSE 0 END::BIGINT AS n_columns FROM c)"""

ORACLES = {
    "statement_facts": f"WITH {_F} SELECT id, kind, intent, tables, hosts, dynamic, unqualified, cursors, uncertainty, n_columns FROM f",
    "statement_relations": f"""WITH {_F} SELECT id, CASE m WHEN 0 THEN b WHEN 4 THEN 'ORD' ELSE 'T1' END AS driver,
CASE m WHEN 0 THEN 'INNER ITEMS I C.ID = I.ID' WHEN 4 THEN 'LEFT CUST ORD.C = CUST.C' ELSE '' END AS joins,
CASE m WHEN 0 THEN 'C.X = :KEY' || z || '; I.Y <> 3' WHEN 11 THEN '(A = 1 OR B = 2)' ELSE '' END AS filters,
CASE m WHEN 11 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, CASE m WHEN 11 THEN 'FILTER_COMPLEX_PREDICATE,LEGACY_JOIN_SYNTAX' ELSE '' END AS marks FROM f WHERE m IN (0, 4, 11)""",
    "statement_summary": f"""WITH {_F} SELECT program, count(*) AS total, count(*) FILTER (intent = 'READ') AS reads, count(*) FILTER (intent = 'WRITE') AS writes, count(*) FILTER (dynamic) AS dynamic,
count(*) FILTER (uncertainty <> '') AS uncertain, count(*) FILTER (cursors <> '') AS with_cursor, len(list_distinct(list_filter(flatten(list(string_split(hosts, ','))), lambda x: x <> '')))::BIGINT AS host_variables FROM f GROUP BY program""",
    "cursor_sets": f"WITH {_F} SELECT string_split(cursors, ':')[1] AS name, array_to_string(list_sort(list_distinct(list(string_split(cursors, ':')[2]))), ',') AS actions FROM f WHERE cursors <> '' GROUP BY 1",
    "merged_statements": f"WITH {_F} SELECT kind, upper(text) AS statement, max(tables) AS tables, count(*) AS n_evidence FROM f GROUP BY 1, 2",
    "table_usage": f"""WITH {_F} SELECT "table", count(*) AS n_statements, bool_or(intent = 'READ') AS is_read, bool_or(intent = 'WRITE') AS is_written FROM (SELECT unnest(string_split(tables, ',')) AS "table", intent FROM f WHERE tables <> '') GROUP BY 1""",
    "statement_risk": f"""WITH {_F}, r AS (SELECT program, CASE WHEN intent = 'WRITE' THEN CASE WHEN tables = 'STOCK' THEN 'RED' ELSE 'YELLOW' END WHEN intent = 'READ' THEN CASE WHEN program = 'Brand#1' THEN 'YELLOW' ELSE 'GREEN' END ELSE 'YELLOW' END AS risk FROM f)
SELECT program, count(*) AS total, count(*) FILTER (risk = 'GREEN') AS green, count(*) FILTER (risk = 'YELLOW') AS yellow, count(*) FILTER (risk = 'RED') AS red,
CASE WHEN bool_or(risk = 'RED') THEN 'RED' WHEN bool_or(risk = 'YELLOW') THEN 'YELLOW' ELSE 'GREEN' END AS level FROM r GROUP BY program""",
    "consistency_findings": f"""WITH {_F} SELECT id, 'MISSING_NULL_HANDLING' AS code, 'WARNING' AS severity FROM f WHERE m = 0 UNION ALL SELECT id, 'MISSING_WHERE_CLAUSE', 'CRITICAL' FROM f WHERE m = 2 UNION ALL SELECT id, 'DYNAMIC_SQL_DETECTED', 'MEDIUM' FROM f WHERE m = 8""",
    "finding_levels": f"""WITH {_F} SELECT program, count(*) FILTER (m = 2) AS critical, 0::BIGINT AS high, CASE WHEN bool_or(m = 2) THEN 'HIGH' ELSE 'LOW' END AS level FROM f WHERE m IN (0, 2, 8) GROUP BY program""",
    "embedded_findings": f"""WITH {_F} SELECT DISTINCT g.id, 'CURSOR_FETCH_MISMATCH' AS code, 'C' || g.z AS subject FROM f g JOIN f h ON h.m = 4 AND h.z = g.z WHERE g.m = 6""",
    "salience_scores": f"""WITH {_F} SELECT id, (20 + CASE intent WHEN 'WRITE' THEN 70 WHEN 'READ' THEN 30 WHEN 'CALL' THEN 25 WHEN 'TRANSACTION' THEN 25 ELSE 0 END + CASE WHEN dynamic THEN 85 ELSE 0 END + CASE WHEN tables = '' THEN 80 ELSE 0 END
+ CASE WHEN uncertainty <> '' THEN 25 ELSE 0 END + CASE WHEN hosts <> '' THEN 10 ELSE 0 END + CASE WHEN m IN (1, 2, 3, 12) THEN 20 ELSE 0 END)::BIGINT AS score FROM f""",
    "filter_changes": f"""WITH {_F}, p AS (SELECT id, unnest(CASE m WHEN 0 THEN ['C.X = :KEY' || z, 'I.Y <> 3'] ELSE ['(A = 1 OR B = 2)'] END) AS pattern FROM f WHERE m IN (0, 11))
SELECT pattern, count(*) FILTER (id % 2 = 0) AS before, count(*) FILTER (id % 2 = 1) AS after FROM p GROUP BY 1 HAVING count(*) FILTER (id % 2 = 0) <> count(*) FILTER (id % 2 = 1)""",
    "entity_scores": "SELECT l_suppkey, (count(*) * 5 + sum(greatest(10, l_linenumber // 2)) + CASE WHEN bool_or(l_quantity > 49) THEN 30 ELSE 0 END)::BIGINT AS score FROM lineitem GROUP BY 1",
    "severity_bands": """WITH r AS (SELECT upper(event_type) AS kind, CASE WHEN event_id % 5 > 0 THEN event_id % 41 END AS severity FROM events)
SELECT 'ERROR' AS band, count(*) AS n FROM r WHERE coalesce(severity, 0) >= 30 UNION ALL SELECT 'WARNING', count(*) FROM r WHERE coalesce(severity, 0) BETWEEN 1 AND 29 UNION ALL SELECT 'INFO', count(*) FROM r WHERE coalesce(severity, 0) = 0""",
    "event_flags": "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds, count(*) AS n, bool_or(value > 50) AS any_large, arg_min(event_type, (ts, event_id)) AS first_kind FROM events GROUP BY user_id",
    "message_summary": "SELECT count(*) AS n_rows, count(DISTINCT event_type) AS n_kinds, count(*) >= 200 AS limit_reached FROM events",
    "masked_customers": "SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN 'MASKED' END AS c_name, CASE WHEN c_mktsegment IS NOT NULL THEN 'SEGMENT' END AS c_mktsegment FROM customer",
    "policy_plan": """SELECT DISTINCT p_brand AS "table", CASE WHEN upper(p_brand) IN ('BRAND#3', 'BRAND#11') THEN 'denied' WHEN replace(p_brand, 'Brand#', '')::INT BETWEEN 1 AND 19 THEN 'allowed' ELSE 'not-allowed' END AS status FROM part""",
    "pseudonyms": "SELECT 'type' AS category, p_type AS value, 'TYPE_' || lpad(row_number() OVER (ORDER BY min(p_partkey), p_type)::VARCHAR, 3, '0') AS placeholder FROM part GROUP BY p_type",
    "redacted_text": f"WITH {_C} SELECT id, replace(replace(text, 'APP.LOG', 'TABLE_001'), 'APP', 'SCHEMA_001') || ' NOTE ''<LITERAL>'' X' AS text FROM c",
    "egress_plan": """SELECT DISTINCT o_orderstatus AS provider, o_orderpriority[1] AS classification, 'eu' AS zone, CASE WHEN o_orderstatus = 'F' AND o_orderpriority[1] = '1' THEN 'deny' WHEN o_orderstatus = 'F' THEN 'allow' WHEN o_orderpriority[1] = '2' THEN 'allow' ELSE 'deny' END AS decision FROM orders""",
    "resolve_objects": f"""WITH c AS ({_CATALOG}), q AS ({_REQUESTED}), a AS (SELECT schema, "table", schema || '.' || "table" AS alias, 1 AS rank FROM c UNION ALL SELECT schema, "table", system_schema || '.' || system_name, 2 FROM c UNION ALL SELECT schema, "table", "table", 3 FROM c UNION ALL SELECT schema, "table", system_name, 4 FROM c),
m AS (SELECT name, schema, "table", min(rank) AS rank FROM q LEFT JOIN a ON replace(upper(name), '/', '.') = alias GROUP BY ALL), n AS (SELECT name, count(rank) AS n_matches, min(rank) AS rank, min(schema) AS schema, min("table") AS t FROM m GROUP BY name)
SELECT name, CASE n_matches WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, n_matches, CASE WHEN n_matches = 1 THEN ['SQL_QUALIFIED_NAME', 'SYSTEM_QUALIFIED_NAME', 'SQL_NAME', 'SYSTEM_NAME'][rank] END AS match_type,
CASE WHEN n_matches = 1 THEN schema END AS schema, CASE WHEN n_matches = 1 THEN t END AS "table" FROM n""",
    "preferred_schema": "SELECT DISTINCT c_mktsegment AS schema FROM customer WHERE upper(c_mktsegment) = 'MACHINERY'",
    "row_sample": "SELECT c_custkey, 'MASKED' AS c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 50",
    "guarded_sql": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL",
    "page_of_orders": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 50",
    "column_like": "SELECT p_partkey, p_type, p_size FROM part WHERE upper(p_type) LIKE '%E%' AND p_size = 7",
}

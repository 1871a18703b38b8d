"""Queries of candidates, catalogue scans, program graphs, blocks, gates and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import blocks
from tracewell.functions import candidates as C
from tracewell.operators import budget, catalog, govern, programs
from tracewell.plans import guard, q_sql
from tracewell.session import cut, table
from tracewell.functions.text import estimate_tokens


def _names(prefix: str, key, *more):
    return F.concat(F.lit(prefix), key, *more)


def line_candidates(spark, d):
    return C.line_candidates(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "line", "category", "score")


def workflow_scores(spark, d):
    """Candidate lines of every document under each workflow, by category."""
    # lines of one category and score weigh the same, so they are read and counted once for all workflows
    found = C.line_candidates(table(spark, d, "documents"), "doc_id", "text").groupBy("category", "score").agg(F.count(F.lit(1)).alias("n"))
    weighed = F.array(*(F.struct(F.lit(w).alias("workflow"), C.workflow_score(F.col("category"), F.col("score"), w).alias("weighed")) for w in C.WORKFLOWS))
    each = found.select("category", "n", F.inline(weighed))
    return each.groupBy("workflow", "category").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("weighed")).alias("total"), F.max("weighed").alias("most"))


def call_scores(spark, d):
    kinds = F.array(*map(F.lit, ("unresolved", "DYNAMIC", " external", "Program", "INTERNAL", "")))
    resolution = F.get(kinds, (F.col("o_orderkey") % 7).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", C.call_score(resolution).alias("score"))


def file_scores(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", C.file_score(k % 2 == 0, F.when(k % 5 > 0, k % 3 == 0), k % 7 == 0, F.col("p_size")).alias("score"))


def table_contexts(spark, d):
    found = q_sql._corpus(spark, d).withColumn("c", F.explode(C.table_contexts(F.col("text"))))
    return found.select("id", "c.table", "c.intent", "c.role")


def standalone_sql(spark, d):
    return q_sql._corpus(spark, d).select("id", C.is_standalone_sql(F.col("text")).alias("standalone"))


def pattern_search(spark, d):
    corpus, tests = q_sql._corpus(spark, d), (("table", C.search_pattern(table="items")), ("member", C.search_pattern(member="Stock7")), ("term", C.search_pattern("where .* or")), ("case", C.search_pattern("exec", case=True)))
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in tests)))
    return corpus.select("id", F.explode(found).alias("kind"))


def error_states(spark, d):
    k = F.col("c_custkey")
    text = F.concat(F.get(F.array(*map(F.lit, ("failed: SQL0204 - ", "sql0551 no authority ", "SQLSTATE = 42s02 ", "SQLSTATE:57014 ", "SQL9999 ", "no code "))), (k % 6).cast("int")), F.col("c_name"))
    return table(spark, d, "customer").groupBy(C.error_state(text).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def row_estimates(spark, d):
    li = table(spark, d, "lineitem")
    parts = li.groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("app").alias("schema"), _names("t", F.col("l_suppkey")).alias("table"), "rows")
    tables = table(spark, d, "supplier").select(F.lit("APP").alias("schema"), _names("T", F.col("s_suppkey")).alias("table")).unionByName(spark.createDataFrame([("APP", "NONE")], "schema string, table string"))
    return catalog.row_estimates(tables, parts)


def dependents(spark, d):
    c = table(spark, d, "customer")
    triggers = c.select(F.lit("app ").alias("t_schema"), _names("t", F.col("c_nationkey")).alias("t_name"), F.lit("trg").alias("o_schema"), F.col("c_name").alias("o_name"), F.lower("c_mktsegment").alias("event"))
    tables = table(spark, d, "nation").filter("n_regionkey = 2").select(F.lit("APP").alias("schema"), _names("T", F.col("n_nationkey")).alias("table"))
    return catalog.dependents(tables, triggers, ("t_schema", "t_name"), ("o_schema", "o_name"), ["event"])


def lookup_tables(spark, d):
    asked = table(spark, d, "orders").select(_names(" t", F.col("o_custkey") % 300).alias("name"))
    s = table(spark, d, "supplier").select(F.lit("cat").alias("schema"), _names("T", F.col("s_suppkey") * 3).alias("table"))
    n = table(spark, d, "nation").select(F.lit("jdbc").alias("schema"), _names("T", F.col("n_nationkey") * 2).alias("table"))
    return catalog.lookup_tables(asked, s, n)


def member_texts(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("member"), F.col("o_orderkey").alias("sequence"), F.concat("o_orderstatus", F.lit("  ")).alias("data"))
    return catalog.member_texts(o)


def member_list(spark, d):
    return catalog.members(table(spark, d, "part").select(F.when(F.col("p_size") % 5 > 0, F.concat("p_brand", F.lit(" "))).otherwise("  ").alias("member")))


def ticket_columns(spark, d):
    return catalog.ticket_columns(table(spark, d, "part").select("p_partkey", "p_type", "p_name"), "p_name")


def with_keys(spark, d):
    return catalog.with_keys(table(spark, d, "lineitem"), {"l_linenumber": 2, "l_returnflag": "R"}).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


def row_counts(spark, d):
    return catalog.row_counts({n: table(spark, d, n) for n in ("nation", "orders", "lineitem")})


def native_targets(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    k = F.col("c_custkey")
    files = c.select(_names("p", F.floor(k / 4)).alias("program"), _names("f", k % 4).alias("name"), pick(("WORKSTN", "PRINTER", "DISK", None), F.col("c_nationkey") % 4).alias("kind"), (k % 2 == 0).alias("keyed"), k.alias("line"))
    j = F.col("o_orderkey")
    ops = o.select(_names("P", F.floor(F.col("o_custkey") / 4)).alias("program"), pick(("EXFMT", "write", "READ"), j % 3).alias("opcode"), _names("F", j % 7).alias("target"))
    return programs.native_targets(ops.distinct(), files)


def _program_facts(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    p = F.col("o_custkey") % 200
    calls = o.select(_names("p", p).alias("program"), F.lit("CALLS_PROGRAM").alias("type"), _names("P", (p * 7 + F.col("o_orderkey") % 3) % 230).alias("name"))
    k = F.col("c_custkey") % 200
    tables = c.select(_names("P", k).alias("program"), F.lit("USES_TABLE").alias("type"), _names("T", k % 30).alias("name"))
    copies = c.select(_names("P", k).alias("program"), F.lit("INCLUDES_COPY").alias("type"), _names("C", k % 11).alias("name"))
    members = c.select(_names("P", k).alias("name"), F.when(k % 50 == 49, _names("/s/", F.col("c_custkey"))).otherwise(_names("/s/", k)).alias("path"))
    return calls.unionByName(tables).unionByName(copies).distinct(), members


def _program_graph(spark, d):
    return programs.program_graph(*_program_facts(spark, d), "p5", programs.Bounds(depth=3))


def program_graph(spark, d):
    return _program_graph(spark, d).edges


def program_graph_summary(spark, d):
    return programs.program_graph_summary(_program_graph(spark, d))


def evidence_graph(spark, d):
    facts, _ = _program_facts(spark, d)
    kind = F.when(F.col("type") == "USES_TABLE", "TABLE").when(F.col("type") == "INCLUDES_COPY", "COPY").otherwise("PROGRAM")
    seen = table(spark, d, "customer").select(F.lit("program").alias("type"), _names("P", F.col("c_custkey") % 200).alias("name"), F.col("c_name").alias("file"), F.col("c_nationkey").cast("long").alias("line"))
    named = facts.filter("type <> 'CALLS_PROGRAM'").select(kind.alias("type"), "name", F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"))
    edges = facts.select(F.lit("PROGRAM").alias("src_type"), F.col("program").alias("src"), "type", kind.alias("dst_type"), F.col("name").alias("dst"))
    nodes, links = programs.evidence_graph(seen.unionByName(named), edges)
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("n_edges"))
    return nodes.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", "type", "n_evidence", F.col("first.file").alias("first_file"), F.coalesce("n_edges", F.lit(0).cast("long")).alias("n_edges"))


_SOURCE = """concat('**FREE', chr(10), 'dcl-pr Post', CAST(s_suppkey AS VARCHAR(9)), ' extpgm(''POST''); id char(10); end-pr;', chr(10), 'dcl-pr Local;', chr(10), '  begsr inside;', chr(10), 'end-pr;', chr(10),
'// dcl-proc Hidden;', chr(10), 'dcl-proc Local export;', chr(10), '  dcl-pi *n int(10);', chr(10), '    a char(5);', chr(10), CASE WHEN s_suppkey % 2 = 0 THEN concat('    b zoned(5);', chr(10)) ELSE '' END, '    dcl-parm c like(x);', chr(10), '  end-pi;', chr(10), '  return a;', chr(10), 'end-proc;', chr(10),
'begsr Work;', chr(10), '  x = 1;', chr(10), 'endsr;', chr(10), 'dcl-proc Open', CAST(s_nationkey AS VARCHAR(9)), ';', chr(10), '  y = 2;')"""


def source_blocks(spark, d):
    files = table(spark, d, "supplier").selectExpr("concat('P', CAST(s_suppkey AS VARCHAR(9)), '.rpgle') AS path", f"{_SOURCE} AS content")
    return blocks.source_blocks(files)


def privacy_gate(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    envelope = F.when(k % 11 == 0, "raw-evidence").when(k % 11 == 1, "sanitized").otherwise("catalog")
    document = F.when(k % 11 == 2, "no json").when(k % 11 == 3, F.concat(F.lit('{"a":"mail x@example.com now","b":"'), "event_type", F.lit('"}'))).when(k % 11 == 4, F.lit(None)).when(k % 11 == 5, F.concat(F.lit('{"a":{"b":["x","mail y@example.com"]},"n":1,"c":"'), "event_type", F.lit('"}'))).otherwise(F.concat(F.lit('{"c":"'), "event_type", F.lit('"}')))
    found = govern.privacy_gate(e.select(k.alias("id"), envelope.alias("envelope"), document.alias("document")))
    return found.select("id", "passed", F.array_join(F.transform("reasons", lambda r: F.concat(r["code"], F.lit("@"), r["path"])), ",").alias("reasons"))


def safe_fields(spark, d):
    k = F.col("s_suppkey")
    path = F.get(F.array(*map(F.lit, ("/home/a", "C:\\a", "c:/a", "\\\\host\\a", "rel/a"))), (k % 6).cast("int"))
    kept = govern.safe_fields(F.create_map(F.lit("name"), F.col("s_name"), F.lit("path"), path))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"))


def focus(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("session"), F.col("o_orderkey").alias("at"), F.array("o_orderstatus").alias("programs"), F.array("o_orderpriority", "o_orderstatus").alias("tables"))
    return govern.merged_focus(o, "session", "at", ["programs", "tables"]).select("session", "last_active", *(F.array_join(c, ",").alias(c) for c in ("programs", "tables")))


def counted_page(spark, d):
    found = C.line_candidates(table(spark, d, "documents"), "doc_id", "text").withColumn("label", F.concat("category", F.lit(":"), "line"))
    order = C.candidate_order("score", "doc_id_", "line", "label")
    named = found.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("doc_id_"), "line", "score", "label")
    return guard.counted_page(cut(named), order, 25, 10)


def plan_packing(spark, d):
    docs = table(spark, d, "documents")
    items = docs.select("source", F.concat(F.lit("doc:"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"), estimate_tokens(F.col("text")).alias("cost"))
    return budget.pack_with_omissions(items, "source", [F.col("id")], 8000)


QUERIES = {f.__name__: f for f in (line_candidates, workflow_scores, call_scores, file_scores, table_contexts, standalone_sql, pattern_search, error_states, row_estimates, dependents, lookup_tables, member_texts, member_list, ticket_columns, with_keys, row_counts, native_targets, program_graph, program_graph_summary, evidence_graph, source_blocks, privacy_gate, safe_fields, focus, counted_page, plan_packing)}

_CORPUS = f"c AS (SELECT p_partkey AS id, {q_sql._STATEMENT} AS text FROM part)"
_FOUND = r"""l AS (SELECT doc_id, generate_subscripts(x, 1)::BIGINT AS line, unnest(x) AS raw FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM documents)),
s AS (SELECT doc_id, line, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t FROM l), f AS (
SELECT doc_id, line, 'conditionals' AS category, 15 + CASE WHEN regexp_matches(t, '(?i)\bMONITOR\b') THEN 30 ELSE 0 END + CASE WHEN regexp_matches(t, '(?i)\b(SELECT|WHEN)\b') THEN 15 ELSE 0 END + CASE WHEN regexp_matches(t, '(?i)\b(IF|ELSEIF|DOW|DOU)\b') THEN 10 ELSE 0 END
  + CASE WHEN regexp_matches(t, '(?i)%ERROR|%EOF|%FOUND|SQLCOD|SQLSTATE|\*IN[0-9]{2}') THEN 25 ELSE 0 END AS score FROM s WHERE regexp_matches(t, '(?i)\b(IF|ELSEIF|WHEN|SELECT|MONITOR|DOW|DOU)\b')
UNION ALL SELECT doc_id, line, 'errorPaths', 35 + CASE WHEN regexp_matches(t, '(?i)\bON-ERROR\b') THEN 60 ELSE 0 END + CASE WHEN regexp_matches(t, '(?i)\b(ROLLBACK|ESCAPE|EXSR)\b') THEN 40 ELSE 0 END + CASE WHEN regexp_matches(t, '(?i)SQLCOD|SQLSTATE|%ERROR|%STATUS') THEN 35 ELSE 0 END
  + CASE WHEN regexp_matches(t, '(?i)\bMONITOR\b') THEN 20 ELSE 0 END FROM s WHERE regexp_matches(t, '(?i)\b(ON-ERROR|ROLLBACK|SQLCOD|SQLSTATE|%ERROR|%STATUS|MONITOR)\b'))"""
_PROGRAMS = """calls AS (SELECT DISTINCT o_custkey % 200 AS src, (o_custkey % 200 * 7 + o_orderkey % 3) % 230 AS dst FROM orders),
m AS (SELECT c_custkey % 200 AS k, count(DISTINCT CASE WHEN c_custkey % 200 % 50 = 49 THEN c_custkey ELSE c_custkey % 200 END) = 1 AS single FROM customer GROUP BY 1),
r(k, depth) AS (SELECT 5::BIGINT, 0 UNION SELECT c.dst, r.depth + 1 FROM r JOIN calls c ON c.src = r.k JOIN m ON m.k = c.dst AND m.single WHERE r.depth < 3),
v AS (SELECT k, min(depth) AS depth FROM r GROUP BY 1),
e AS (SELECT 'P' || src AS src, 'P' || dst AS dst, 'CALLS_PROGRAM' AS type FROM calls WHERE src IN (SELECT k FROM v) UNION SELECT 'P' || (c_custkey % 200), 'T' || (c_custkey % 200 % 30), 'USES_TABLE' FROM customer WHERE c_custkey % 200 IN (SELECT k FROM v)
  UNION SELECT 'P' || (c_custkey % 200), 'C' || (c_custkey % 200 % 11), 'INCLUDES_COPY' FROM customer WHERE c_custkey % 200 IN (SELECT k FROM v))"""
_LEADS = " UNION ALL ".join(f"SELECT id, upper(list_extract(string_split(regexp_extract(text, '(?i)\\b{lead}([A-Za-z0-9_]+[A-Za-z0-9_.]*)\\b', 1), '.'), -1)) AS \"table\", '{intent}' AS intent, '{role}' AS role FROM c" for role, intent, lead in C.TABLE_CONTEXTS)

ORACLES = {
    "line_candidates": f"WITH {_FOUND} SELECT doc_id, line, category, score::BIGINT AS score FROM f",
    "workflow_scores": f"""WITH {_FOUND}, w AS (SELECT * FROM (VALUES {", ".join(f"('{w}', '{k}', {x}::DOUBLE)" for w, ks in C.WORKFLOWS.items() for k, x in ks.items())}) v(workflow, category, weight))
SELECT workflow, category, count(*) AS n, sum(floor(score * weight + 0.5)::BIGINT)::BIGINT AS total, max(floor(score * weight + 0.5)::BIGINT) AS most FROM f JOIN w USING (category) GROUP BY 1, 2""",
    "call_scores": "SELECT o_orderkey, [110, 100, 55, 40, 30, 20, 20][o_orderkey % 7 + 1]::BIGINT AS score FROM orders",
    "file_scores": "SELECT p_partkey, (20 + CASE WHEN p_partkey % 2 = 0 THEN 80 ELSE 0 END + CASE WHEN p_partkey % 5 > 0 AND p_partkey % 3 = 0 THEN 70 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 15 ELSE 0 END + 8 * p_size)::BIGINT AS score FROM part",
    "table_contexts": f"""WITH {_CORPUS}, t AS ({_LEADS}) SELECT * FROM t WHERE "table" NOT IN ('', 'FROM', 'INTO', 'WHERE')""",
    "standalone_sql": f"WITH {_CORPUS} SELECT id, regexp_matches(upper(trim(text)), '^SELECT\\b.*\\bFROM\\b|^INSERT\\b.*\\bINTO\\b|^UPDATE\\b.*\\bSET\\b|^DELETE\\s+FROM\\b|^MERGE\\s+INTO\\b|^WITH\\b') AS standalone FROM c",
    "pattern_search": f"""WITH {_CORPUS} SELECT id, unnest(list_filter([CASE WHEN regexp_matches(upper(text), '(FROM|INTO|UPDATE|JOIN)\\s+ITEMS') THEN 'table' END, CASE WHEN regexp_matches(upper(text), '(^|[^A-Z0-9_])STOCK7([^A-Z0-9_]|$)') THEN 'member' END,
CASE WHEN regexp_matches(lower(text), 'where .* or') THEN 'term' END, CASE WHEN contains(text, 'exec') THEN 'case' END], lambda x: x IS NOT NULL)) AS kind FROM c""",
    "error_states": "SELECT ['42704', '42501', '42S02', '57014', 'SQL9999', ''][c_custkey % 6 + 1] AS state, count(*) AS n FROM customer GROUP BY 1",
    "row_estimates": """WITH t AS (SELECT DISTINCT 'T' || s_suppkey AS "table" FROM supplier UNION SELECT 'NONE'), p AS (SELECT 'T' || l_suppkey AS "table", count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'APP' AS schema, "table", n AS estimated_rows FROM t LEFT JOIN p USING ("table")""",
    "dependents": """SELECT 'APP' AS schema, 'T' || c_nationkey AS "table", 'TRG' AS object_schema, upper(c_name) AS object_name, upper(c_mktsegment) AS event FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2""",
    "lookup_tables": """WITH a AS (SELECT DISTINCT 'T' || (o_custkey % 300) AS name FROM orders), s AS (SELECT DISTINCT 'T' || (s_suppkey * 3) AS t FROM supplier), n AS (SELECT DISTINCT 'T' || (n_nationkey * 2) AS t FROM nation)
SELECT name, CASE WHEN s.t IS NOT NULL THEN 'CAT' WHEN n.t IS NOT NULL THEN 'JDBC' END AS schema, coalesce(s.t, n.t) AS "table", CASE WHEN s.t IS NOT NULL THEN 'CATALOG' WHEN n.t IS NOT NULL THEN 'FALLBACK' ELSE 'NONE' END AS strategy
FROM a LEFT JOIN s ON s.t = name LEFT JOIN n ON n.t = name""",
    "member_texts": "SELECT o_custkey % 40 AS member, string_agg(rtrim(o_orderstatus), chr(10) ORDER BY o_orderkey, rtrim(o_orderstatus)) AS content FROM orders GROUP BY 1",
    "member_list": "SELECT DISTINCT p_brand AS member FROM part WHERE p_size % 5 > 0",
    "ticket_columns": "SELECT p_partkey, p_type, p_name FROM part WHERE regexp_matches(upper(p_name), 'STATUS|NR|DATUM|USER|TIME|ID')",
    "with_keys": "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber = 2 AND l_returnflag = 'R' GROUP BY 1",
    "row_counts": "SELECT 'nation' AS \"table\", count(*) AS n_rows FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem",
    "native_targets": """WITH f AS (SELECT c_custkey // 4 AS p, 'F' || (c_custkey % 4) AS name, ['WORKSTN', 'PRINTER', 'DISK', 'FILE'][c_nationkey % 4 + 1] AS kind, c_custkey % 2 = 0 AS keyed FROM customer),
o AS (SELECT DISTINCT o_custkey // 4 AS p, ['EXFMT', 'WRITE', 'READ'][o_orderkey % 3 + 1] AS opcode, 'F' || (o_orderkey % 7) AS target FROM orders),
s AS (SELECT p, kind, min(name) AS name, bool_or(keyed) AS keyed FROM f WHERE kind IN ('WORKSTN', 'PRINTER') GROUP BY 1, 2 HAVING count(*) = 1),
j AS (SELECT o.*, d.name AS dn, d.kind AS dk, d.keyed AS dd, w.name AS wn, w.kind AS wk, w.keyed AS wd, r.name AS rn, r.kind AS rk, r.keyed AS rd FROM o LEFT JOIN f d ON d.p = o.p AND d.name = o.target
  LEFT JOIN s w ON w.p = o.p AND w.kind = 'WORKSTN' AND opcode IN ('EXFMT', 'WRITE') LEFT JOIN s r ON r.p = o.p AND r.kind = 'PRINTER' AND opcode = 'WRITE')
SELECT 'P' || p AS program, opcode, target, coalesce(dn, rn, wn) AS file, coalesce(dk, rk, wk) AS kind, coalesce(dd, rd, wd) AS keyed, CASE WHEN dn IS NULL AND coalesce(rn, wn) IS NOT NULL THEN target END AS record FROM j""",
    "program_graph": f"WITH RECURSIVE {_PROGRAMS} SELECT src, dst, type FROM e",
    "program_graph_summary": f"""WITH RECURSIVE {_PROGRAMS}, p AS (SELECT DISTINCT dst AS name FROM e WHERE type = 'CALLS_PROGRAM'), u AS (SELECT name, m.k IS NULL AS gone FROM p LEFT JOIN m ON 'P' || m.k = name WHERE m.k IS NULL OR NOT single),
a AS (SELECT count(*) AS n FROM calls c JOIN v ON v.k = c.src AND v.depth = 3 JOIN m ON m.k = c.dst AND single WHERE c.dst NOT IN (SELECT k FROM v))
SELECT (SELECT count(*) FROM (SELECT 'P' || k FROM v UNION SELECT name FROM p)) AS n_programs, count(DISTINCT dst) FILTER (type = 'USES_TABLE') AS n_tables, count(DISTINCT dst) FILTER (type = 'INCLUDES_COPY') AS n_copies, count(*) AS n_edges,
(SELECT count(*) FROM u) AS n_unresolved, (SELECT count(*) FROM u WHERE NOT gone) AS n_ambiguous, (SELECT n > 0 FROM a) AS truncated, (SELECT CASE WHEN n > 0 THEN 'MAX_DEPTH' ELSE '' END FROM a) AS reached FROM e""",
    "evidence_graph": """WITH c AS (SELECT c_custkey % 200 AS k, c_name, c_nationkey FROM customer), f AS (SELECT DISTINCT o_custkey % 200 AS src, 'PROGRAM:P' || ((o_custkey % 200 * 7 + o_orderkey % 3) % 230) AS dst FROM orders
  UNION SELECT k, 'TABLE:T' || (k % 30) FROM c UNION SELECT k, 'COPY:C' || (k % 11) FROM c),
n AS (SELECT 'PROGRAM:P' || k AS id, 'PROGRAM' AS type, count(DISTINCT (c_name, c_nationkey)) AS n_evidence, min(c_name) AS first_file FROM c GROUP BY 1 UNION ALL SELECT DISTINCT 'TABLE:T' || (k % 30), 'TABLE', 0, NULL FROM c UNION ALL SELECT DISTINCT 'COPY:C' || (k % 11), 'COPY', 0, NULL FROM c),
o AS (SELECT 'PROGRAM:P' || src AS id, count(*) AS n FROM f WHERE dst IN (SELECT id FROM n) AND 'PROGRAM:P' || src IN (SELECT id FROM n) GROUP BY 1)
SELECT n.*, coalesce(o.n, 0) AS n_edges FROM n LEFT JOIN o USING (id)""",
    "source_blocks": """WITH s AS (SELECT 'P' || s_suppkey || '.rpgle' AS path, s_suppkey AS k, s_nationkey AS n, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS b FROM supplier)
SELECT path, 'PROTOTYPE' AS kind, 'POST' || k AS name, 2::BIGINT AS start, 2::BIGINT AS "end", false AS exported, 'POST' AS external, true AS imported, 0::BIGINT AS n_parameters FROM s
UNION ALL SELECT path, 'PROTOTYPE', 'LOCAL', 3, 5, false, NULL, false, 0 FROM s UNION ALL SELECT path, 'PROCEDURE', 'LOCAL', 7, 13 + b, true, NULL, false, 3 + b FROM s
UNION ALL SELECT path, 'SUBROUTINE', 'WORK', 14 + b, 16 + b, false, NULL, false, 0 FROM s UNION ALL SELECT path, 'PROCEDURE', 'OPEN' || n, 17 + b, 18 + b, false, NULL, false, 0 FROM s""",
    "privacy_gate": """SELECT event_id AS id, event_id % 11 > 5 AS passed, CASE event_id % 11 WHEN 0 THEN 'RAW_EVIDENCE_NOT_ALLOWED@$' WHEN 1 THEN 'SANITIZED_NOT_FINAL@$' WHEN 2 THEN 'MALFORMED_FINAL_CATALOG@$' WHEN 3 THEN 'EMAIL@$.a,URL_OR_HOST@$.a' WHEN 4 THEN 'MALFORMED_FINAL_CATALOG@$' WHEN 5 THEN 'EMAIL@$.a.b[1],URL_OR_HOST@$.a.b[1]' ELSE '' END AS reasons FROM events""",
    "safe_fields": "SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 4 THEN 'name,path' ELSE 'name' END AS kept FROM supplier",
    "focus": """SELECT o_custkey % 20 AS session, max(o_orderkey) AS last_active, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS programs,
array_to_string(list_sort(list_distinct(list_concat(list(o_orderpriority), list(o_orderstatus)))), ',') AS tables FROM orders GROUP BY 1""",
    "counted_page": f"""WITH {_FOUND} SELECT lpad(doc_id::VARCHAR, 12, '0') AS doc_id_, line, score::BIGINT AS score, category || ':' || line AS label, count(*) OVER () AS total, count(*) OVER () > 35 AS omitted
FROM f ORDER BY score DESC, doc_id_, line, label LIMIT 25 OFFSET 10""",
    "plan_packing": """
WITH RECURSIVE o AS (SELECT source, 'doc:' || lpad(doc_id::VARCHAR, 12, '0') AS id, ceil(length(text) / 4.0)::BIGINT AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f(source, k, id, cost, used, fits) AS (SELECT source, k, id, cost, CASE WHEN cost <= 8000 THEN cost ELSE 0 END, cost <= 8000 FROM o WHERE k = 1
  UNION ALL SELECT o.source, o.k, o.id, o.cost, f.used + CASE WHEN f.used + o.cost <= 8000 THEN o.cost ELSE 0 END, f.used + o.cost <= 8000 FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1)
SELECT source, id, cost, NOT fits AS omitted FROM f""",
}

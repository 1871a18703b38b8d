"""Queries of source-line facts, packages, catalogue scans and windowed events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import candidates
from tracewell.functions import source_lines as L
from tracewell.functions import text as X
from tracewell.operators import context, search
from tracewell.sources import files
from tracewell.streaming import incremental
from tracewell.plans import q_text
from tracewell.session import cut, table

#: A small program of each customer; the same text builds the corpus in both engines.
_PROGRAM = """concat('**FREE', chr(10), 'ctl-opt nomain bnddir(''BND', CAST(c_nationkey AS VARCHAR(9)), ''');', chr(10), 'dcl-f FILE', CAST(c_custkey % 7 AS VARCHAR(9)), ' disk usage(*update) keyed;', chr(10),
'/COPY QRPGLESRC,CPY', CAST(c_custkey % 3 AS VARCHAR(9)), chr(10), '// CALL ''NOTME''', chr(10), 'dcl-proc Main export;', chr(10), 'chain (k) FILE', CAST(c_custkey % 7 AS VARCHAR(9)), ';', chr(10),
'update FILE', CAST(c_custkey % 7 AS VARCHAR(9)), ';', chr(10), 'CALL ''PGM', CAST(c_custkey * 7 % 100 AS VARCHAR(9)), ''';', chr(10), 'callp Main();', chr(10), 'exec sql select A from T', CAST(c_custkey % 5 AS VARCHAR(9)), chr(10), '  where B = :X;', chr(10), 'end-proc;')"""


def _files(spark, d):
    return table(spark, d, "customer").selectExpr("concat('src/P', CAST(c_custkey AS VARCHAR(9)), '.rpgle') AS path", f"{_PROGRAM} AS content")


def source_facts(spark, d):
    facts = L.source_facts(_files(spark, d)).filter("fact in ('FILE', 'COPY', 'CALL', 'PROCEDURE', 'BINDING_DIRECTORY', 'MODULE', 'NATIVE_IO')")
    return facts.groupBy("fact", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files"), F.min("line").alias("line"))


def native_file_usage(spark, d):
    return L.file_usage(L.source_facts(_files(spark, d))).groupBy("name").agg(F.bool_or("read").alias("read"), F.bool_or("update").alias("updated"), F.bool_or("write").alias("written"), F.bool_or("changing").alias("changing"), F.array_join(F.array_distinct(F.flatten(F.collect_set("opcodes"))), ",").alias("opcodes"))


def procedure_calls(spark, d):
    return L.classified_calls(L.source_facts(_files(spark, d))).groupBy("name", "resolution").agg(F.count(F.lit(1)).alias("n"))


def embedded_sql(spark, d):
    return L.embedded_statements(_files(spark, d))


def source_types(spark, d):
    pages = table(spark, d, "documents").select(F.concat(F.lit("a."), F.element_at(F.array(*map(F.lit, ("rpg", "clle", "dspf", "bnd", "xyz"))), (F.col("doc_id") % 5 + 1).cast("int"))).alias("path"))
    kind = L.source_type(F.col("path"))
    return pages.groupBy(kind.alias("type"), L.source_family(kind).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def source_inventory(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("size"))
    return files.inventory(docs, "docs").select("root", "path", "hash", "size", "n_lines", "newlines", "has_bom", "language")


def member_summary(spark, d):
    return files.catalog_summary(table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("member"), F.col("o_orderkey").cast("string").alias("path")))


def context_package(spark, d):
    """Symbols, evidence and contents of every document; a quarter of the hashes is stale, a fifth of the contents is gone."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    found = search.lexical_search(search.search_documents(docs, "doc_id", "source", "text"), "the license of")
    # twenty rows at most; they are met several times
    hits = cut(found.select(F.concat(F.lit("doc:symbol:"), "doc_id").alias("id"), F.lit("symbol").alias("kind"), F.concat(F.lit("Hit "), "doc_id").alias("title"), "score", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("hash")))
    symbols = docs.select(k.cast("string").alias("id"), F.concat(F.lit("P"), k).alias("name"), F.when(k % 3 == 0, "UNRESOLVED_SYMBOL").otherwise("PROGRAM").alias("kind"), k.cast("string").alias("unit"))
    links = docs.select(k.cast("string").alias("src"), (k + 1).cast("string").alias("dst"), F.lit("NEXT").alias("type"))
    path, hash_ = F.concat(F.lit("d/"), k), F.when(k % 4 == 0, F.lit("old")).otherwise(X.content_hash(F.col("text")))
    evidence = docs.select(F.concat(F.lit("e"), k).alias("id"), k.cast("string").alias("unit"), path.alias("path"), hash_.alias("hash"))
    contents = docs.filter("doc_id % 5 <> 2").select(path.alias("path"), F.col("text").alias("content"))
    return context.context_package(hits, symbols, links, evidence, contents, "the license of", 3000)


def event_windows(spark, d):
    return incremental.event_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


_CAPS = {"sql": 4, "calls": 3, "fileUsage": 3, "conditionals": 2, "errorPaths": 5}


def workflow_selection(spark, d):
    """Two workflows: in one the very first item costs more than the budget, the other is bounded by budget and caps."""
    category = F.element_at(F.array(*map(F.lit, ("sql", "calls", "fileUsage", "conditionals", "errorPaths", "other"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    dear = F.when((F.col("p_partkey") % 6 == 4) & (F.col("p_size") > 25), 700).otherwise(F.col("p_partkey") % 40 + 5)
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), category.alias("category"), F.col("p_size").cast("double").alias("score"), dear.alias("cost"))
    parts = [context.workflow_selection(items, w, 600, _CAPS).withColumn("workflow", F.lit(w)) for w in ("errorAnalysis", "security")]
    return parts[0].unionByName(parts[1].select(parts[0].columns))


QUERIES = {f.__name__: f for f in (source_facts, native_file_usage, procedure_calls, embedded_sql, source_types, source_inventory, member_summary, context_package, event_windows, workflow_selection)}

ORACLES = {
    "source_facts": """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer), f AS (
SELECT k, 'FILE' AS fact, 'FILE' || (k % 7) AS name, 3 AS line FROM c UNION ALL SELECT k, 'COPY', 'QRPGLESRC,CPY' || (k % 3), 4 FROM c UNION ALL SELECT k, 'CALL', 'PGM' || (k * 7 % 100), 9 FROM c
UNION ALL SELECT k, 'PROCEDURE', 'MAIN', 6 FROM c UNION ALL SELECT k, 'BINDING_DIRECTORY', 'BND' || n, 2 FROM c UNION ALL SELECT k, 'MODULE', '*SELF', 2 FROM c
UNION ALL SELECT k, 'NATIVE_IO', 'FILE' || (k % 7), 7 FROM c UNION ALL SELECT k, 'NATIVE_IO', 'FILE' || (k % 7), 8 FROM c)
SELECT fact, name, count(*) AS n, count(DISTINCT k) AS files, min(line)::BIGINT AS line FROM f GROUP BY 1, 2""",
    "native_file_usage": "SELECT DISTINCT 'FILE' || (c_custkey % 7) AS name, true AS read, true AS updated, false AS written, true AS changing, 'CHAIN,UPDATE' AS opcodes FROM customer",
    "procedure_calls": "SELECT 'MAIN' AS name, 'INTERNAL' AS resolution, count(*) AS n FROM customer",
    "embedded_sql": "SELECT 'src/P' || c_custkey || '.rpgle' AS path, 11::BIGINT AS start, 12::BIGINT AS \"end\", 'exec sql select A from T' || (c_custkey % 5) || ' where B = :X;' AS text FROM customer",
    "source_types": "SELECT ['RPG', 'CLLE', 'DSPF', 'BND', 'UNKNOWN'][doc_id % 5 + 1] AS type, ['RPG', 'CL', 'DDS', 'RPG', 'UNKNOWN'][doc_id % 5 + 1] AS family, count(*) AS n FROM documents GROUP BY 1, 2",
    "source_inventory": "SELECT 'docs' AS root, 'd/' || doc_id || '.txt' AS path, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS hash, n_chars AS size, len(string_split(text, chr(10)))::BIGINT AS n_lines, CASE WHEN contains(text, chr(10)) THEN 'LF' ELSE 'NONE' END AS newlines, false AS has_bom, 'txt' AS language FROM documents",
    "member_summary": "SELECT sum(n)::BIGINT AS n_files, count(*) AS n_members, count(*) FILTER (n > 1) AS n_ambiguous FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey % 500)",
    "event_windows": "SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "context_package": f"""
WITH RECURSIVE s AS ({q_text.ORACLES["lexical_search"].strip()}),
n AS (SELECT node, min(depth) AS depth FROM (SELECT doc_id AS node, 0 AS depth FROM s UNION ALL SELECT doc_id + 1, 1 FROM s UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM s)) GROUP BY node),
g AS (SELECT n.node, depth, d.doc_id IS NOT NULL AS known, text FROM n LEFT JOIN documents d ON d.doc_id = n.node),
graph AS (SELECT 'graph' AS bucket, node::VARCHAR AS id, 'symbol' AS kind, CASE WHEN known THEN 'P' || node ELSE node::VARCHAR END AS title, NULL::VARCHAR AS body,
  CASE WHEN NOT known THEN 'symbol ' || node WHEN node % 3 = 0 THEN 'UNRESOLVED_SYMBOL P' || node || ' (' || node || ')' ELSE 'PROGRAM P' || node || ' (' || node || ')' END AS text, CASE WHEN depth = 0 THEN 1000.0 ELSE 100.0 END::DOUBLE AS score, NULL::VARCHAR AS reason FROM g),
i AS (
  SELECT 'summary' AS bucket, 'summary:project:current' AS id, 'summary' AS kind, 'project-snapshot' AS title, NULL::VARCHAR AS body, 'Project project snapshot current. Query: the license of. Seeds: ' || (SELECT count(*) FROM s) || '. Neighborhood: ' || (SELECT count(*) FROM n) || '.' AS text, 1e9::DOUBLE AS score, NULL::VARCHAR AS reason
  UNION ALL SELECT * FROM graph UNION ALL SELECT 'unresolved', id, 'unresolved', title, body, text, score, reason FROM graph WHERE starts_with(text, 'UNRESOLVED')
  UNION ALL SELECT 'source', 'doc:symbol:' || doc_id, 'symbol', 'Hit ' || doc_id, NULL, 'Hit ' || doc_id, score, NULL FROM s
  UNION ALL SELECT 'source', 'doc:evidence:e' || node, 'evidence', 'd/' || node, CASE WHEN node % 5 <> 2 AND node % 4 <> 0 THEN substring(text, 1, 1500) END, CASE WHEN node % 5 <> 2 AND node % 4 <> 0 THEN substring(text, 1, 1500) ELSE 'd/' || node END, 50, CASE WHEN node % 5 = 2 THEN 'MISSING' WHEN node % 4 = 0 THEN 'STALE' END FROM g WHERE known),
c AS (SELECT *, ceil(length(CASE WHEN body IS NULL THEN to_json({{'id': id, 'kind': kind, 'title': title, 'text': text}}) ELSE to_json({{'id': id, 'kind': kind, 'title': title, 'body': body, 'text': text}}) END::VARCHAR) / 4.0)::BIGINT AS cost FROM i),
o AS (SELECT *, map {{'summary': 300, 'graph': 750, 'source': 1350, 'unresolved': 300}}[bucket] AS most, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, id) AS k FROM c WHERE reason IS NULL),
f(bucket, k, used, fits) AS (SELECT bucket, k, CASE WHEN cost <= most THEN cost ELSE 0 END, cost <= most FROM o WHERE k = 1
  UNION ALL SELECT o.bucket, o.k, f.used + CASE WHEN f.used + o.cost <= o.most THEN o.cost ELSE 0 END, f.used + o.cost <= o.most FROM f JOIN o ON o.bucket = f.bucket AND o.k = f.k + 1)
SELECT c.bucket, c.id, c.kind, c.score, c.cost, CASE WHEN reason IS NOT NULL THEN reason WHEN f.fits THEN 'SELECTED' ELSE 'TOKEN_BUDGET' END AS status
FROM c LEFT JOIN (SELECT o.bucket, o.id, f.fits FROM o JOIN f USING (bucket, k)) f ON f.bucket = c.bucket AND f.id = c.id""",
    "workflow_selection": f"""
WITH RECURSIVE w(workflow, m, weight, turn, cap) AS (VALUES ('errorAnalysis', 0, 1.45, 1, 4), ('errorAnalysis', 1, 1.35, 2, 3), ('errorAnalysis', 2, 1.25, 3, 3), ('errorAnalysis', 3, 1.05, 4, 2), ('errorAnalysis', 4, 1.7, 0, 5),
 {', '.join(f"('security', {m}, {candidates.WORKFLOWS['security'][c]}, {context.OTHER_ORDER.index(c)}, {_CAPS[c]})" for m, c in enumerate(('sql', 'calls', 'fileUsage', 'conditionals', 'errorPaths')))}),
i AS (SELECT workflow, p_partkey AS id, turn, cap, p_size AS score, floor(p_size * weight::DOUBLE + 0.5)::BIGINT AS weighed, CASE WHEN m = 4 AND p_size > 25 THEN 700 ELSE p_partkey % 40 + 5 END AS cost FROM part JOIN w ON m = p_partkey % 6),
h AS (SELECT *, row_number() OVER (PARTITION BY workflow, turn ORDER BY score DESC, id) = 1 AS head FROM i),
o AS (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY NOT head, CASE WHEN head THEN turn ELSE -weighed END, id) AS k FROM h),
f(workflow, k, used, n, taken, fits) AS (SELECT workflow, k, cost, 1, turn::VARCHAR, true FROM o WHERE k = 1
  UNION ALL SELECT workflow, k, used + CASE WHEN g THEN cost ELSE 0 END, n + CASE WHEN g THEN 1 ELSE 0 END, CASE WHEN g THEN taken || turn ELSE taken END, g
  FROM (SELECT o.workflow, o.k, o.cost, o.turn, f.used, f.n, f.taken, f.used + o.cost <= 380 AND length(f.taken) - length(replace(f.taken, o.turn::VARCHAR, '')) < o.cap AS g FROM f JOIN o ON o.workflow = f.workflow AND o.k = f.k + 1))
SELECT o.workflow, o.id, o.cost::BIGINT AS cost, f.n::BIGINT AS place FROM o JOIN f USING (workflow, k) WHERE fits""",
}

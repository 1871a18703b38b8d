"""Queries of graphs and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.text import content_hash
from tracewell.operators import delta, graph, search
from tracewell.session import table


def _edges(spark, d):
    t = lambda n: table(spark, d, n)
    return graph.relations({
        "IN_REGION": (t("nation"), "n_nationkey", "NATION", "n_regionkey", "REGION"),
        "CUSTOMER_OF": (t("customer"), "c_custkey", "CUSTOMER", "c_nationkey", "NATION"),
        "SUPPLIER_OF": (t("supplier"), "s_suppkey", "SUPPLIER", "s_nationkey", "NATION"),
        "ORDERED_BY": (t("orders"), "o_orderkey", "ORDER", "o_custkey", "CUSTOMER"),
        "SUPPLIED_BY": (t("lineitem"), "l_partkey", "PART", "l_suppkey", "SUPPLIER"),
    })


_EDGES = """edges AS (
  SELECT 'NATION:' || n_nationkey AS src, 'REGION:' || n_regionkey AS dst, 'IN_REGION' AS type FROM nation UNION
  SELECT 'CUSTOMER:' || c_custkey, 'NATION:' || c_nationkey, 'CUSTOMER_OF' FROM customer UNION
  SELECT 'SUPPLIER:' || s_suppkey, 'NATION:' || s_nationkey, 'SUPPLIER_OF' FROM supplier UNION
  SELECT 'ORDER:' || o_orderkey, 'CUSTOMER:' || o_custkey, 'ORDERED_BY' FROM orders UNION
  SELECT 'PART:' || l_partkey, 'SUPPLIER:' || l_suppkey, 'SUPPLIED_BY' FROM lineitem)"""
#: A cyclic call graph over customers, derived from their keys.
_CALLS = """calls AS (
  SELECT c_custkey AS src, c_custkey * 7 % (SELECT count(*) FROM customer) + 1 AS dst FROM customer UNION
  SELECT c_custkey, c_custkey * 5 % (SELECT count(*) FROM customer) + 1 FROM customer WHERE c_custkey % 3 = 0)"""


def _calls(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    n = c.count()
    one = c.select(F.col("c_custkey").alias("src"), (F.col("c_custkey") * 7 % n + 1).alias("dst"))
    two = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") * 5 % n + 1).alias("dst"))
    return one.unionByName(two).distinct()


def relation_summary(spark, d):
    return graph.graph_summary(_edges(spark, d))


def impact_nation(spark, d):
    return graph.impact(_edges(spark, d), "NATION:3")


def call_impact_cyclic(spark, d):
    return graph.impact(_calls(spark, d), 1, 6)


def call_closure(spark, d):
    return graph.closure(_calls(spark, d), spark.createDataFrame([(5,)], "node long"), 12).select("node", F.col("depth").cast("long").alias("depth"))


def bounded_closure(spark, d):
    nodes, codes = graph.bounded_closure(_calls(spark, d), spark.createDataFrame([(5,)], "node long"), 4, 500)
    return nodes.select("node", F.col("depth").cast("long").alias("depth"), F.lit(",".join(codes)).alias("bounds"))


def khop_supplier(spark, d):
    nodes, _ = graph.neighbourhood(_edges(spark, d), spark.createDataFrame([("SUPPLIER:1",)], "node string"), 2)
    return nodes.select("node", F.col("depth").cast("long").alias("hop"))


def khop_edges(spark, d):
    _, edges = graph.neighbourhood(_edges(spark, d), spark.createDataFrame([("NATION:1",)], "node string"), 1)
    return edges


def degree_view(spark, d):
    return graph.degrees(_edges(spark, d))


def typed_paths(spark, d):
    found = graph.paths(_edges(spark, d), spark.createDataFrame([("REGION:1",)], "node string"), 2, ["IN_REGION", "SUPPLIER_OF"])
    return found.select("node", F.array_join("path", ">").alias("path"))


def callee_resolution(spark, d):
    """Members from every customer: names of ten remainders have two paths, those of the other twenty one, and ten callees none."""
    k = F.col("c_custkey") % 30
    calls = table(spark, d, "orders").select(F.col("o_orderkey").alias("caller"), F.concat(F.lit("prog"), F.col("o_custkey") % 40).alias("callee"))
    members = table(spark, d, "customer").select(F.concat(F.lit("PROG"), k).alias("name"), F.concat(F.lit("/src/"), k * 2 + F.when(k < 10, F.col("c_nationkey") % 2).otherwise(0)).alias("path"))
    return graph.resolve_callees(calls, members)


def lineage_trace(spark, d):
    return graph.lineage_mentions(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "a", 30).select("p_name")


def graph_text(spark, d):
    return graph.mermaid(_edges(spark, d).filter("type in ('IN_REGION', 'SUPPLIER_OF')")).select("text", F.col("line").cast("long").alias("line"))


def _after_customers(spark, d):
    c = table(spark, d, "customer")
    kept = c.filter("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return kept.unionByName(c.filter("c_custkey % 13 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))


def snapshot_diff(spark, d):
    found = delta.snapshot_diff(table(spark, d, "customer"), _after_customers(spark, d), ["c_custkey"])
    return found.select("key_text", "change", F.array_join(F.array_sort(F.map_keys("diffs")), ",").alias("changed"))


def rollback_sql(spark, d):
    cols = ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"]
    before = table(spark, d, "customer").select(*cols)
    after = before.filter("c_custkey % 11 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    return delta.rollback_statements(delta.snapshot_diff(before, after, ["c_custkey"]), "APP.CUSTOMER", "c_custkey")


def inventory_diff(spark, d):
    docs = table(spark, d, "documents").select(F.lit("docs").alias("root"), F.concat(F.lit("d/"), F.col("doc_id")).alias("path"), "doc_id", content_hash(F.col("text")).alias("hash"))
    after = docs.filter("doc_id % 9 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.sha2("hash", 256)).otherwise(F.col("hash")))
    after = after.unionByName(docs.filter("doc_id % 10 = 3").withColumn("path", F.concat(F.lit("new/"), F.col("doc_id"))))
    return delta.inventory_diff(docs, after)


def invalidation(spark, d):
    facts = table(spark, d, "orders").select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("unit"))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("dst")).distinct()
    kept = table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("unit"))
    valid, left = delta.keep_valid_facts(facts, links, kept)
    return valid.agg(F.count(F.lit(1)).alias("n_facts")).crossJoin(left.agg(F.count(F.lit(1)).alias("n_links")))  # one row each


def set_difference(spark, d):
    li = table(spark, d, "lineitem")
    return delta.added_and_removed(li.filter("l_returnflag = 'R'"), li.filter("l_returnflag = 'A'"), ["l_partkey", "l_suppkey"])


def line_diff(spark, d):
    lines = search.text_lines(table(spark, d, "documents"), "doc_id", "text")
    left = lines.filter("doc_id % 2 = 0").select((F.col("doc_id") / 2).cast("long").alias("pair"), "line", "text")
    right = lines.filter("doc_id % 2 = 1").select(((F.col("doc_id") - 1) / 2).cast("long").alias("pair"), "line", "text")
    return delta.line_diff(left, right, ["pair"]).groupBy("pair", "marker").agg(F.count(F.lit(1)).alias("n_lines"))


def group_fingerprint(spark, d):
    return delta.fingerprint(table(spark, d, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("string")), ["n_nationkey", "n_name"], "n_regionkey")


QUERIES = {f.__name__: f for f in (relation_summary, impact_nation, call_impact_cyclic, call_closure, bounded_closure, khop_supplier, khop_edges, degree_view, typed_paths, callee_resolution, lineage_trace, graph_text, snapshot_diff, rollback_sql, inventory_diff, invalidation, set_difference, line_diff, group_fingerprint)}

_BOTH = "both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"
_LEVELS = "WITH RECURSIVE {with_}, r(node, depth) AS ({seed} UNION SELECT e.{b}, r.depth + 1 FROM r JOIN {edges} e ON e.{a} = r.node WHERE r.depth < {most}) SELECT node, min(depth)::BIGINT AS {name} FROM r GROUP BY node"

ORACLES = {
    "relation_summary": f"WITH {_EDGES} SELECT type, count(*) AS n_edges, count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_targets FROM edges GROUP BY type",
    "impact_nation": f"""WITH RECURSIVE {_EDGES}, r(node, depth) AS (SELECT src, 1 FROM edges WHERE dst = 'NATION:3' UNION SELECT e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.node)
SELECT node, CASE WHEN min(depth) = 1 THEN 'direct' ELSE 'indirect' END AS scope, min(depth)::BIGINT AS depth FROM r GROUP BY node""",
    "call_impact_cyclic": f"""WITH RECURSIVE {_CALLS}, r(node, depth) AS (SELECT src, 1 FROM calls WHERE dst = 1 UNION SELECT e.src, r.depth + 1 FROM r JOIN calls e ON e.dst = r.node WHERE r.depth <= 6)
SELECT node, CASE WHEN min(depth) = 1 THEN 'direct' ELSE 'indirect' END AS scope, min(depth)::BIGINT AS depth FROM r GROUP BY node""",
    "call_closure": _LEVELS.format(with_=_CALLS, seed="SELECT 5::BIGINT, 0", edges="calls", a="src", b="dst", most=12, name="depth"),
    "bounded_closure": "SELECT *, 'MAX_DEPTH' AS bounds FROM (" + _LEVELS.format(with_=_CALLS, seed="SELECT 5::BIGINT, 0", edges="calls", a="src", b="dst", most=4, name="depth") + ")",
    "khop_supplier": _LEVELS.format(with_=f"{_EDGES}, {_BOTH}", seed="SELECT 'SUPPLIER:1', 0", edges="both_", a="src", b="dst", most=2, name="hop"),
    "khop_edges": f"""WITH {_EDGES}, n AS (SELECT 'NATION:1' AS node UNION SELECT src FROM edges WHERE dst = 'NATION:1' UNION SELECT dst FROM edges WHERE src = 'NATION:1')
SELECT src, dst, type FROM edges WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)""",
    "degree_view": f"""WITH {_EDGES}, i AS (SELECT dst AS node, count(*) AS incoming FROM edges GROUP BY 1), o AS (SELECT src AS node, count(*) AS outgoing FROM edges GROUP BY 1)
SELECT node, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing FROM i FULL JOIN o USING (node)""",
    "typed_paths": f"""WITH {_EDGES}, k AS (SELECT * FROM edges WHERE type IN ('IN_REGION', 'SUPPLIER_OF'))
SELECT 'REGION:1' AS node, 'REGION:1' AS path UNION ALL SELECT src, 'REGION:1>IN_REGION>' || src FROM k WHERE dst = 'REGION:1'
UNION ALL SELECT s.src, min('REGION:1>IN_REGION>' || n.src || '>SUPPLIER_OF>' || s.src) FROM k n JOIN k s ON s.dst = n.src AND s.type = 'SUPPLIER_OF' WHERE n.dst = 'REGION:1' GROUP BY s.src""",
    "callee_resolution": """WITH p AS (SELECT c_custkey % 30 AS k, c_custkey % 30 * 2 + CASE WHEN c_custkey % 30 < 10 THEN c_nationkey % 2 ELSE 0 END AS place FROM customer),
m AS (SELECT 'PROG' || k AS name, count(DISTINCT place) AS n, '/src/' || min(place) AS path FROM p GROUP BY 1)
SELECT o_orderkey AS caller, 'prog' || (o_custkey % 40) AS callee, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN path END AS path
FROM orders LEFT JOIN m ON m.name = upper('prog' || (o_custkey % 40))""",
    "lineage_trace": "SELECT p_name FROM part WHERE contains(upper(p_name), 'A') ORDER BY p_name LIMIT 30",
    "graph_text": f"""WITH {_EDGES} SELECT '  ' || regexp_replace(src, '[^A-Za-z0-9_]', '_', 'g') || ' -->|' || type || '| ' || regexp_replace(dst, '[^A-Za-z0-9_]', '_', 'g') AS text,
row_number() OVER (ORDER BY src, dst, type) AS line FROM edges WHERE type IN ('IN_REGION', 'SUPPLIER_OF')""",
    "snapshot_diff": """SELECT c_custkey::VARCHAR AS key_text, 'DELETED' AS change, '' AS changed FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT c_custkey::VARCHAR, 'UPDATED', 'c_acctbal' FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 = 0
UNION ALL SELECT (c_custkey + 1000000)::VARCHAR, 'INSERTED', '' FROM customer WHERE c_custkey % 13 = 0""",
    "rollback_sql": """SELECT c_custkey::VARCHAR AS key_text, 'DELETED' AS change, 'INSERT INTO APP.CUSTOMER (c_custkey, c_name, c_mktsegment, c_nationkey) VALUES (' || c_custkey || ', ''' || replace(c_name, '''', '''''') || ''', ''' || c_mktsegment || ''', ' || c_nationkey || ');' AS statement FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT c_custkey::VARCHAR, 'UPDATED', 'UPDATE APP.CUSTOMER SET c_nationkey = ' || c_nationkey || ' WHERE c_custkey = ' || c_custkey || ';' FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 = 0""",
    "inventory_diff": """SELECT 'docs' AS root, 'd/' || doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN 'deleted' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM documents
UNION ALL SELECT 'docs', 'new/' || doc_id, 'added' FROM documents WHERE doc_id % 10 = 3""",
    "invalidation": """WITH f AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)), l AS (SELECT DISTINCT l_orderkey AS src, l_orderkey + l_linenumber AS dst FROM lineitem)
SELECT (SELECT count(*) FROM f) AS n_facts, (SELECT count(*) FROM l WHERE src IN (SELECT * FROM f) AND dst IN (SELECT * FROM f)) AS n_links""",
    "set_difference": """WITH b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')
SELECT *, 'removed' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'added' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "line_diff": """WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
a AS (SELECT doc_id // 2 AS pair, line, text AS before FROM l WHERE doc_id % 2 = 0), b AS (SELECT (doc_id - 1) // 2 AS pair, line, text AS after FROM l WHERE doc_id % 2 = 1)
SELECT pair, CASE WHEN before IS NULL THEN '+' WHEN after IS NULL THEN '-' WHEN before = after THEN ' ' ELSE '~' END AS marker, count(*) AS n_lines FROM a FULL JOIN b USING (pair, line) GROUP BY 1, 2""",
    "group_fingerprint": "WITH h AS (SELECT n_regionkey, sha256(concat_ws(chr(0), n_nationkey::VARCHAR, n_name)) AS h FROM nation), s AS (SELECT n_regionkey, count(*) AS n_rows, "
    + ", ".join(f"sum(('0x' || substring(h, {1 + 12 * k}, 12))::BIGINT)::VARCHAR AS s{k}" for k in range(5)) + " FROM h GROUP BY 1) SELECT n_regionkey, n_rows, sha256(concat_ws('|', n_rows::VARCHAR, s0, s1, s2, s3, s4)) AS fingerprint FROM s",
}

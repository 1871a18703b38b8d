"""Cases of our own for program graphs, blocks, packages, gates, catalogue scans and pages."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import blocks
from tracewell.functions import candidates as C
from tracewell.operators import budget, catalog, context, govern, programs
from tracewell.plans import guard


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def graph_of(spark, bounds):
    calls = [("A", "B"), ("A", "C"), ("A", "D"), ("B", "E"), ("C", "E"), ("E", "A"), ("E", "F"), ("A", "GONE"), ("B", "TWICE"), ("C", "bad name")]
    facts = spark.createDataFrame([(p.lower() + " ", "CALLS_PROGRAM", n) for p, n in calls] + [("A", "USES_TABLE", "T1"), ("E", "USES_TABLE", "T2"), ("F", "INCLUDES_COPY", "CP")], "program string, type string, name string")
    members = spark.createDataFrame([(n, f"/{n}") for n in "ABCDEF"] + [("TWICE", "/1"), ("TWICE", "/2")], "name string, path string")
    return programs.program_graph(facts, members, "a", bounds)


def test_program_graph_without_a_bound(spark):
    g = graph_of(spark, programs.Bounds())
    assert g.reached == () and len(values(g.edges)) == 12
    assert values(g.unresolved) == [("GONE", "unresolved"), ("TWICE", "ambiguous")]
    one = programs.program_graph_summary(g).first()
    assert (one["n_programs"], one["n_tables"], one["n_copies"], one["n_edges"], one["truncated"]) == (8, 2, 1, 12, False)


@pytest.mark.parametrize(
    ("bounds", "code", "programs_left"),
    [
        (programs.Bounds(depth=1), "MAX_DEPTH", {"A", "B", "C", "D", "E", "GONE", "TWICE"}),
        (programs.Bounds(programs=2), "MAX_PROGRAMS", {"A", "B", "C", "D", "E", "GONE", "TWICE"}),
        (programs.Bounds(files=1), "MAX_FILES", {"A", "B", "C", "D", "GONE"}),
        (programs.Bounds(calls=2), "MAX_CALLS", {"A", "B", "C", "E", "F", "TWICE"}),
        (programs.Bounds(nodes=3), "MAX_NODES", {"A", "B", "C"}),
    ],
)
def test_program_graph_bounds(spark, bounds, code, programs_left):
    g = graph_of(spark, bounds)
    assert code in g.reached
    assert {r["id"] for r in g.nodes.filter("type = 'PROGRAM'").collect()} == programs_left


def test_program_graph_edge_bound_and_unknown_root(spark):
    g = graph_of(spark, programs.Bounds(edges=4))
    assert g.reached == ("MAX_EDGES",) and g.edges.count() == 4
    facts = spark.createDataFrame([], "program string, type string, name string")
    alone = programs.program_graph(facts, spark.createDataFrame([], "name string, path string"), "x")
    assert values(alone.nodes) == [("X", "PROGRAM")] and values(alone.edges) == [] and alone.reached == ()


def test_blocks_hold_what_they_hold(spark):
    text = "dcl-pr A;\r\n  dcl-proc inner;\r\nend-pr;\r\ndcl-proc P;\r\n begsr S;\r\n endsr;\r\nend-proc;\r\n     C     SUB1          BEGSR\r\n x = 1;\r\n     C                   ENDSR\r\ndcl-proc Q export; end-proc;\r\nbegsr last;"
    found = blocks.source_blocks(spark.createDataFrame([("a", text), ("b", None), ("c", "")], "path string, content string"))
    got = [(r["kind"], r["name"], r["start"], r["end"], r["exported"], r["imported"]) for r in found.orderBy("start").collect()]
    assert got == [("PROTOTYPE", "A", 1, 3, False, True), ("PROCEDURE", "P", 4, 7, False, False), ("SUBROUTINE", "SUB1", 8, 10, False, False), ("PROCEDURE", "Q", 11, 11, True, False), ("SUBROUTINE", "LAST", 12, 12, False, False)]


def test_context_package_statuses(spark):
    hits = spark.createDataFrame([("doc:symbol:1", "symbol", "one", 9.0, None, None), ("doc:file:7", None, "seven", 8.0, "/7", "no")], "id string, kind string, title string, score double, path string, hash string")
    symbols = spark.createDataFrame([("1", "ONE", "PROGRAM", "u1"), ("2", "TWO", "UNRESOLVED_SYMBOL", None)], "id string, name string, kind string, unit string")
    links = spark.createDataFrame([("1", "2", "CALLS"), ("2", "3", "CALLS")], "src string, dst string, type string")
    contents = spark.createDataFrame([("/7", "x"), ("/1", "body " * 400)], "path string, content string")
    from hashlib import sha256

    evidence = spark.createDataFrame([("e1", "u1", "/1", sha256(("body " * 400).encode()).hexdigest()), ("e2", "u1", "/gone", "h")], "id string, unit string, path string, hash string")
    notes = spark.createDataFrame([("n", "note", "text", 1.0)], "id string, title string, text string, score double")
    found = {(r["bucket"], r["id"]): r["status"] for r in context.context_package(hits, symbols, links, evidence, contents, "q", 1000, diagnostics=notes).collect()}
    assert found == {
        ("summary", "summary:project:current"): "SELECTED", ("graph", "1"): "SELECTED", ("graph", "2"): "SELECTED", ("unresolved", "2"): "SELECTED", ("diagnostics", "n"): "SELECTED",
        ("source", "doc:symbol:1"): "SELECTED", ("source", "doc:file:7"): "STALE", ("source", "doc:evidence:e1"): "TOKEN_BUDGET", ("source", "doc:evidence:e2"): "MISSING",
    }


def test_line_and_error_scores(spark):
    lines = "  IF SQLCOD = 0;\nmonitor;\non-error;\nx = y;\n\nEXSR *INLR;"
    found = C.line_candidates(spark.createDataFrame([("f", lines), ("g", None)], "path string, content string"), "path", "content")
    assert values(found.select("line", "category", "score")) == [(1, "conditionals", 50), (1, "errorPaths", 70), (2, "conditionals", 45), (2, "errorPaths", 55), (3, "errorPaths", 95)]
    one = spark.range(1).select(C.workflow_score(F.lit("calls"), F.lit(10), "security").alias("a"), C.workflow_score(F.lit("other"), F.lit(7), "unknown").alias("b"), C.call_score(F.lit(None).cast("string")).alias("c")).first()
    assert tuple(one) == (16, 7, 20)
    assert C.search_pattern() is None and C.search_pattern("a.b", case=True) == "a.b"


def test_gate_and_fields(spark):
    rows = [(1, "raw-evidence", "{}"), (2, "catalog", '{"a":"plain"}'), (3, "catalog", None), (4, "catalog", '{"a":"password here"}'), (5, None, "[1]")]
    found = govern.privacy_gate(spark.createDataFrame(rows, "id int, envelope string, document string"))
    assert [(r["id"], r["passed"], [x["code"] for x in r["reasons"]]) for r in found.orderBy("id").collect()] == [(1, False, ["RAW_EVIDENCE_NOT_ALLOWED"]), (2, True, []), (3, False, ["MALFORMED_FINAL_CATALOG"]), (4, False, ["TOKEN_OR_SECRET"]), (5, False, ["MALFORMED_FINAL_CATALOG"])]


def test_pages_keys_and_patterns(spark):
    rows = spark.range(45)
    last = guard.counted_page(rows, ["id"], offset=40).collect()
    assert [r["id"] for r in last] == [40, 41, 42, 43, 44] and not last[0]["omitted"] and last[0]["total"] == 45
    assert guard.counted_page(rows, ["id"]).first()["omitted"]
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}):
        with pytest.raises(ValueError):
            guard.counted_page(rows, ["id"], **bad)
    assert guard.key_select("app", "t", {"k": 1, "n": "o'x"}, ["a"]) == "SELECT A FROM APP.T WHERE K = 1 AND N = 'o''x'"
    with pytest.raises(ValueError):
        guard.key_select("app", "t", {"k; drop": 1})
    with pytest.raises(ValueError):
        catalog.columns_like(rows, "id", ["a'b"])


def test_packing_names_what_is_left_out(spark):
    items = spark.createDataFrame([("a", "x", 5, 8), ("a", "y", 5, 8), ("b", "x", 5, 4), ("b", "z", 4, 4)], "bucket string, id string, cost long, most long")
    found = budget.pack_with_omissions(items, "bucket", [F.col("id")], "most")
    assert values(found.select("bucket", "id", "omitted")) == [("a", "x", False), ("a", "y", True), ("b", "x", True), ("b", "z", False)]

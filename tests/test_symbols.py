"""Symbols of program text: scopes, unresolved names, and the same graph from a full and an incremental snapshot."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions.text import content_hash
from tracewell.operators import symbols
from tracewell.operators.documents import snapshot_view
from tracewell.operators.store import SnapshotStore

MAIN = "**FREE\nctl-opt bndsrvpgm('TOOLS');\ndcl-f custfile;\n/COPY QRPGLESRC,COMMON\ndcl-pr price;\nend-pr;\ndcl-ds line;\ncallp setup();\ndcl-proc setup export;\n  callp shared();\n  callp nowhere();\n  CALL 'HELPER';\n  CALL 'GONE';\n  exec sql select A from CUSTOMERS where B = 1;\nend-proc;\n"
HELPER = "**FREE\ndcl-proc shared export;\n  CALL 'MAIN';\n  callp setup();\nend-proc;\n"


def units(spark, rows):
    return spark.createDataFrame(rows, "root string, path string, content string").withColumn("hash", content_hash(F.col("content"))).select("root", "path", "hash", "content")


def test_graph_of_program_text(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    number = store.full(units(spark, [("r", "src/MAIN.rpgle", MAIN), ("r", "src/HELPER.rpgle", HELPER), ("r", "src/TOOLS.bnd", "STRPGMEXP\n"), ("r", "src/NONE.rpgle", "")]), symbols.symbol_facts)
    graph = symbols.graph_of_snapshot(store.units(number), store.facts(number))
    found = {r["id"]: r for r in graph.symbols.collect()}
    kinds = {k: r["kind"] for k, r in found.items()}
    assert kinds["sym:program:r:src/MAIN.rpgle"] == kinds["sym:program:r:src/NONE.rpgle"] == "PROGRAM" and kinds["sym:program:r:src/TOOLS.bnd"] == "SERVICE_PROGRAM"
    assert kinds["sym:proc:r:src/MAIN.rpgle:SETUP"] == "PROCEDURE" and kinds["sym:unresolved:program:GONE"] == kinds["sym:unresolved:proc:NOWHERE"] == "UNRESOLVED_SYMBOL"
    assert {"sym:file:CUSTFILE", "sym:table:CUSTOMERS", "sym:srvpgm:TOOLS", "sym:ds:r:src/MAIN.rpgle:LINE", "sym:proto:r:src/MAIN.rpgle:PRICE"} <= kinds.keys()
    hash_ = {r["path"]: r["hash"] for r in store.units(number).collect()}
    one = found["sym:proc:r:src/MAIN.rpgle:SETUP"]
    assert (one["hash"], one["derivation"], one["confidence"], one["line"]) == (hash_["src/MAIN.rpgle"], "VERIFIED", "high", 9)
    edges = {(r["type"], r["src"].rpartition(":")[2], r["dst"].rpartition(":")[2], r["confidence"]) for r in graph.relationships.collect()}
    assert {
        ("BOUND_PROCEDURE_CALL", "src/MAIN.rpgle", "SETUP", "medium"), ("BOUND_PROCEDURE_CALL", "SETUP", "SHARED", "medium"), ("BOUND_PROCEDURE_CALL", "SHARED", "SETUP", "medium"), ("DYNAMIC_UNRESOLVED_CALL", "SETUP", "NOWHERE", "low"),
        ("PROGRAM_CALL", "src/MAIN.rpgle", "src/HELPER.rpgle", "high"), ("DYNAMIC_UNRESOLVED_CALL", "src/MAIN.rpgle", "GONE", "low"), ("SQL_REFERENCE", "src/MAIN.rpgle", "CUSTOMERS", "medium"), ("SERVICE_PROGRAM_IMPORT", "src/MAIN.rpgle", "TOOLS", "medium"),
    } <= edges
    assert {(r["kind"], r["name"]) for r in graph.unresolved.collect()} == {("PROGRAM_CALL", "GONE"), ("PROCEDURE_CALL", "NOWHERE")}


def test_full_and_incremental_graphs_are_equal(spark, tmp_path):
    before = [("r", "MAIN.rpgle", MAIN), ("r", "HELPER.rpgle", "**FREE\n"), ("q", "OLD.rpgle", HELPER)]
    after = [("r", "MAIN.rpgle", MAIN), ("r", "HELPER.rpgle", HELPER)]
    full, steps = SnapshotStore(spark, f"{tmp_path}/full"), SnapshotStore(spark, f"{tmp_path}/steps")
    full.full(units(spark, after), symbols.symbol_facts)
    steps.full(units(spark, before), symbols.symbol_facts)
    steps.incremental(units(spark, after), symbols.symbol_facts)

    def view(store, number):
        graph = symbols.graph_of_snapshot(store.units(number), store.facts(number))
        return sorted(map(tuple, snapshot_view(store.units(number), graph.symbols.withColumnRenamed("unit", "path"), graph.relationships).collect()))

    assert view(full, 1) == view(steps, 2) and view(steps, 1) != view(steps, 2)


@pytest.mark.parametrize("rows,src,dst", [
    ([("r", "a", "P"), ("r", "b", "P"), ("q", "c", "P")], "r:b", "r:b"), ([("r", "a", "P"), ("q", "c", "P")], "r:b", "r:a"), ([("q", "c", "P"), ("q", "a", "P")], "r:b", "q:a"), ([("x", "gone", "P")], "r:b", None),
])
def test_nearest_scope_wins(spark, rows, src, dst):
    known = spark.createDataFrame([("r", "a"), ("r", "b"), ("q", "c"), ("q", "a")], "root string, path string").selectExpr("*", "'h' AS hash", "'RPG' AS family")
    mentions = spark.createDataFrame([*((r, p, 1, "PROCEDURE", n, None) for r, p, n in rows), ("r", "b", 5, "PROCEDURE_CALL", " p", None), ("r", "b", 6, "CALL", None, None), ("r", "b", 7, "ODD", "n", None)], "root string, path string, line int, kind string, name string, owner string")
    edges = symbols.symbol_graph(known, mentions).relationships.collect()
    assert [(r["src"], r["dst"]) for r in edges] == [(f"sym:program:{src}", f"sym:proc:{dst}:P" if dst else "sym:unresolved:proc:P")]


def test_nothing(spark):
    none = symbols.symbol_graph(spark.createDataFrame([], "root string, path string, hash string, family string"), spark.createDataFrame([], "root string, path string, line int, kind string, name string, owner string"))
    assert none.symbols.count() == none.relationships.count() == none.unresolved.count() == 0

"""Work on rows of small tables is spread over the cores, and done once a row."""

import re

import pytest

import __spark_entry__
from tracewell.operators import delta, graph, model
from tracewell.plans import catalogue

STATEMENTS = ("statement_relations", "filter_changes", "cursor_sets", "table_usage")
SOURCES = ("procedure_calls", "entity_model", "source_facts", "model_summary")


def _plan(spark, name):
    return catalogue.queries()[name](spark, __spark_entry__.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", [*STATEMENTS, *SOURCES, "typed_edit"])
def test_texts_are_read_after_the_rows_are_dealt_out(spark, name):
    before, *after = re.split(r"Repartition \d+, true", _plan(spark, name))
    assert after and not any(re.search(r"(?i)rlike|regexp|variant|posexplode", part) for part in after[-1:])
    assert re.search(r"(?i)rlike|regexp|variant", before)


def test_names_and_files_are_counted_without_a_copy_of_the_facts_for_each_count(spark):
    assert "Expand" not in _plan(spark, "model_summary") and "Expand" not in _plan(spark, "entity_model")
    facts = spark.createDataFrame([("a", 1, "FILE", "X"), ("a", 1, "FILE", "X"), ("a", 2, "FILE", "X"), ("b", 1, "FILE", "X"), (None, 9, "FILE", "X"), ("b", 3, "CALL", None), ("c", 4, "OTHER", "X"), ("c", 4, None, "Y")], "path string, line long, fact string, name string")
    assert [tuple(r) for r in model.model_summary(facts, ("FILE", "CALL")).collect()] == [(1, 0, 3)]
    found = {r.id: (r.n_evidence, r.files) for r in model.entities(facts).collect()}
    assert found["FILE:X"] == (3, 2) and found["OTHER:X"] == (1, 1)


def test_lines_are_read_once_for_all_workflows(spark):
    assert _plan(spark, "workflow_scores").count("Relation [") + _plan(spark, "workflow_scores").count("Relation[") == 1


def test_more_edges_make_more_parts_and_counts_make_no_copies(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART_ROWS", 10)
    rows = spark.range(100).selectExpr("id % 40 AS a", "CASE WHEN id % 40 > 0 THEN id % 4 END AS b")
    edges = graph.relations({"R": (rows, "a", "A", "b", "B"), "S": (rows, "b", "B", "b", "B")})
    assert re.search(r"RepartitionByExpression .*, 20\b", edges._jdf.queryExecution().optimizedPlan().toString())
    summary = graph.graph_summary(edges)
    assert "Expand" not in summary._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, summary.select("type", "n_edges", "n_sources", "n_targets").collect())) == [("R", 39, 39, 4), ("S", 4, 4, 4)]


def test_hops_send_nothing_to_the_driver(spark, monkeypatch):
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    reached = graph.closure(edges, spark.createDataFrame([(1,)], "node long"))
    assert sorted(map(tuple, reached.collect())) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert not any("Broadcast" in p for p in plans)


def test_sides_are_grouped_in_one_step(spark):
    old, new = (spark.createDataFrame(rows, "a long, b long") for rows in ([(1, 1), (1, 1), (2, None), (3, 3)], [(2, None), (3, 3), (4, None), (4, None)]))
    found = delta.added_and_removed(old, new, ["a", "b"])
    assert sorted(map(tuple, found.collect())) == [(1, 1, "removed"), (4, None, "added")]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()

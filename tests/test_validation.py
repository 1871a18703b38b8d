"""Candidate validation: order, needs, registries, faults within rules, odd documents."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.operators import validation as V


def document(**more):
    return json.dumps({"schemaVersion": 1, "candidateId": "c", "proposedFiles": [{"path": "src/a.rpgle", "content": "x"}], "evidenceReferences": [{"id": "e", "kind": "source"}]} | more)


def run(spark, documents, **options):
    evidence = spark.createDataFrame([("e", "source"), ("free", None)], "id string, kind string")
    found = V.validate(spark.createDataFrame(list(enumerate(documents)), "id long, document string"), evidence, **options)
    return {r["id"]: (r["status"], r["ran"], [(d["rule"], d["code"]) for d in r["diagnostics"]]) for r in found.collect()}


def test_a_failing_schema_stops_later_rules(spark):
    got = run(spark, [document(), None, "no json", "[]", document(proposedFiles=[]), document(proposedFiles=[{"action": "create"}])])
    assert got[0][0] == "review-ready" and got[0][1] == [r.id for r in V.BUILT_IN] and got[0][2] == []
    for k in range(1, 6):
        assert got[k][0] == "invalid" and got[k][1] == ["schema"] and {d for d in got[k][2]} == {("schema", "SCHEMA_INVALID")}


def test_limits_and_paths(spark):
    file = lambda p, **m: {"path": p, "content": "x"} | m
    many = [file(f"src/{k}.sql") for k in range(33)]
    got = run(spark, [
        document(proposedFiles=many), document(proposedFiles=[file("a.sql", content="é" * 131073)]), document(proposedFiles=[file(f"{k}.sql", content="x" * 262144) for k in range(5)]),
        document(proposedFiles=[file("a.sql"), file("./A.SQL"), file("b/../a.sql"), file("//s/a.sql"), file("\\a.sql"), file("x/COM1.txt"), file(" "), file("a\n.sql")]),
        document(proposedFiles=[file("a.sql", action="delete", content="\x00")]), document(evidenceReferences=[{"id": "free", "kind": "any"}, {"id": None}]), document(proposedFiles=[file("a")], additionalFiles=[]),
    ])
    codes = {k: [c for _, c in v[2]] for k, v in got.items()}
    assert codes[0] == ["TOO_MANY_FILES"] and codes[1] == ["CONTENT_TOO_LARGE"] and codes[2] == ["TOTAL_CONTENT_TOO_LARGE"]
    assert codes[3].count("DUPLICATE_TARGET") == 1 and codes[3].count("PATH_UNSAFE") == 6
    assert codes[4] == [] and codes[5] == ["EVIDENCE_UNKNOWN"] and codes[6] == ["FILE_TYPE_DENIED"]
    assert "UNDECLARED_FILE" in [c for _, c in run(spark, [document(additionalFiles=[])], policy=V.Policy(scope=("src",)))[0][2]]
    assert run(spark, [document()], policy=V.Policy(deny="no"))[0][0] == "denied"


def test_registries(spark):
    warn = V.Rule("house", 95, lambda c, p: V._one(F.size(c["files"]) > 0, "HOUSE", severity="warning"), needs=("policy",))
    got = run(spark, [document(), document(proposedFiles=[{"path": "a.sql", "action": "burn"}])], registry=V.default_registry().register(warn))
    assert got[0][0] == "review-ready" and got[0][2] == [("house", "HOUSE")] and got[0][1][-2:] == ["house", "static-parse"]
    assert got[1][0] == "denied" and "house" not in got[1][1]

    def broken(c, p):
        raise KeyError("inner detail")

    got = run(spark, [document()], registry=V.Registry(required=("schema", "gone")).register(V.BUILT_IN[0], V.Rule("broken", 20, broken), V.Rule("last", 30, V.BUILT_IN[1].check)))
    assert got[0] == ("internal-validator-failure", ["schema", "broken", "last"], [("broken", "VALIDATOR_INTERNAL"), ("registry", "VALIDATOR_MISSING")])
    for bad in ((warn,), (V.BUILT_IN[0], V.BUILT_IN[0]), (V.Rule("", 1, broken),), (V.Rule("v", 1, broken, version=0),), (V.Rule("b", 9, broken, needs=("schema",)), V.BUILT_IN[0])):
        with pytest.raises(ValueError):
            V.Registry().register(*bad)
    assert run(spark, []) == {}

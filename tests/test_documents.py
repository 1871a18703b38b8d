"""Nested documents: walks, typed edits, change sets and equality against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import nested
from tracewell.operators import documents, govern


def made(r, depth=0):
    kind = r.randrange(7 if depth < 4 else 5)
    if kind == 5:
        return {r.choice(["a", "b c", "d"]): made(r, depth + 1) for _ in range(r.randrange(4))}
    if kind == 6:
        return [made(r, depth + 1) for _ in range(r.randrange(4))]
    return [1, "x \"[{\\ é", True, None, 2.5][kind]


def walk(value, path="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")
    else:
        yield path, value


def test_leaves_of_any_depth(spark):
    r = random.Random(9)
    values = [made(r) for _ in range(200)]
    deep = "leaf"
    for k in range(30):
        deep = {"n": deep} if k % 2 else [deep]
    values.append(deep)
    rows = [(k, json.dumps(v, ensure_ascii=k % 2 == 0)) for k, v in enumerate(values)]
    df = spark.createDataFrame([*rows, (900, "no json"), (901, None), (902, '{"a":1,"a":2}')], "id long, document string")
    got = {(r["id"], r["path"], json.loads(r["v"])) for r in nested.leaves(df, "document", ["id"]).select("id", "path", F.to_json("value").alias("v")).collect()}
    assert got == {(k, p, x) for k, v in enumerate(values) for p, x in walk(v)}
    texts = {tuple(r) for r in nested.text_leaves(df, "document", ["id"]).collect()}
    assert texts == {(k, p, x) for k, v in enumerate(values) for p, x in walk(v) if isinstance(x, str)}
    assert nested.leaves(df.limit(0), "document", ["id"]).count() == 0


def set_at(v, steps, new):
    head, rest = steps[0], steps[1:]
    if isinstance(v, list) and head.isdigit():
        v = v + [None] * (int(head) + 1 - len(v))
        v[int(head)] = set_at(v[int(head)], rest, new) if rest else new
        return v
    v = dict(v) if isinstance(v, dict) else {}
    v[head] = set_at(v.get(head), rest, new) if rest else new
    return v


def drop_at(v, steps):
    head, rest = steps[0], steps[1:]
    if isinstance(v, list) and head.isdigit() and int(head) < len(v):
        return [(drop_at(x, rest) if rest else None) if i == int(head) else x for i, x in enumerate(v)]
    if isinstance(v, dict) and head in v:
        return {k: drop_at(x, rest) if k == head and rest else x for k, x in v.items() if k != head or rest}
    return v


@pytest.mark.parametrize("path", ["a", "a.d", "d.1", "a.0.b c", "d.2.a.0"])
def test_edits_at_paths(spark, path):
    r = random.Random(path)
    values = [{"a": made(r), "d": made(r), "b c": 1} for _ in range(60)] + [{}, {"d": [[1, {"a": [2]}], {"a": 3}, {"a": [4]}]}]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "id long, document string")
    v = nested.parsed(F.col("document"))
    got = df.select("id", F.to_json(nested.with_value(v, path, nested.variant({"n": [7]}))).alias("s"), F.to_json(nested.without_value(v, path)).alias("d")).collect()
    for row in got:
        assert json.loads(row["s"]) == set_at(values[row["id"]], path.split("."), {"n": [7]})
        assert json.loads(row["d"]) == drop_at(values[row["id"]], path.split("."))


def test_untouched_fields_keep_their_types(spark):
    row = spark.createDataFrame([('{"k": 3, "o": {"a": [1]}, "big": 12345678901234567890, "t": true}',)], "d string").select(nested.with_field(F.col("d"), "tag", F.lit("5")).alias("w"), nested.without_field(F.col("d"), "k").alias("o"), nested.with_field(F.lit("[1]"), "x", F.lit("y")).alias("none")).first()
    assert row["w"] == '{"big":12345678901234567890,"k":3,"o":{"a":[1]},"t":true,"tag":"5"}' and row["o"] == '{"big":12345678901234567890,"o":{"a":[1]},"t":true}' and row["none"] is None


def test_change_sets(spark):
    docs = spark.createDataFrame([(1, '{"items":[{"id":"a","v":1},{"id":"b"}],"x":1.50}'), (2, "[]"), (3, None), (4, '{"items":5}')], "id long, document string")
    apply = lambda *ops: {r["id"]: (r["document"], r["problem"], r["notes"]) for r in documents.apply_changes(docs, ops).collect()}
    got = apply({"type": "update", "where": {"id$in": ["a", "b"]}, "set": {"v": {"w": 2}}, "multiple": True}, {"type": "remove", "where": {"id": "a"}})
    assert got[1] == ('{"items":[{"id":"b","v":{"w":2}}],"x":1.5}', None, ["updated a", "updated b", "removed a"])
    assert got[2] == ("[]", "NO_OBJECT", []) and got[3] == (None, "NO_OBJECT", []) and got[4] == ('{"items":5}', "1:NO_MATCH", [])
    assert apply({"type": "update", "where": {}, "set": {"v": 1}})[1][1] == "1:SEVERAL_MATCHES"
    assert apply({"type": "insert", "where": {}, "item": {"name": "n"}, "multiple": True})[1][0] == '{"items":[{"id":"a","v":1},{"id":"b"},{"name":"n"}],"x":1.5}'
    with pytest.raises(ValueError, match="unknown operation"):
        documents.apply_changes(docs, [{"type": "paint"}])


def test_gate_sees_inner_paths(spark):
    rows = [(1, "catalog", '{"a":[{"b":"password here"}],"n":5}'), (2, "catalog", '{"a":{"b":"plain"}}')]
    found = {r["id"]: (r["passed"], [tuple(x) for x in r["reasons"]]) for r in govern.privacy_gate(spark.createDataFrame(rows, "id int, envelope string, document string")).collect()}
    assert found == {1: (False, [("TOKEN_OR_SECRET", "$.a[0].b")]), 2: (True, [])}


def test_equality_of_full_and_incremental(spark, tmp_path):
    from tracewell.functions.text import content_hash
    from tracewell.operators.store import SnapshotStore

    analyse = lambda units: units.select("path", F.lit(1).cast("long").alias("line"), F.lit("RPG").alias("type"), F.lit("LENGTH").alias("fact"), F.length("content").cast("string").alias("name"), F.lit(None).cast("string").alias("detail"))
    units = lambda rows: spark.createDataFrame(rows, "root string, path string, content string").withColumn("hash", content_hash(F.col("content"))).select("root", "path", "hash", "content")
    before, after = [("r", "a", "one"), ("r", "b", "two")], [("r", "b", "two!"), ("r", "c", "three"), ("r", "a", "one")]
    slow, fast = SnapshotStore(spark, f"{tmp_path}/full"), SnapshotStore(spark, f"{tmp_path}/inc")
    slow.full(units(after), analyse)
    fast.full(units(before), analyse)
    fast.incremental(units(after[::-1]), analyse)
    views = [sorted(map(tuple, s.equality(s.current()).collect())) for s in (slow, fast)]
    assert views[0] == views[1] and len(views[0]) == 2
    assert views[0] != sorted(map(tuple, fast.equality(1).collect()))


def test_equality_view_ignores_orders(spark):
    one = spark.sql("SELECT id, map('b', 1, 'a', id) AS m, named_struct('y', array(id, 2), 'x', 'é') AS s FROM range(50)")
    two = spark.sql("SELECT named_struct('x', 'é', 'y', array(id, 2)) AS s, id, map('a', id, 'b', 1) AS m FROM range(50) ORDER BY id DESC")
    prints = {r["name"]: (r["n_rows"], r["fingerprint"]) for r in documents.equality_view(one=one, two=two, less=one.limit(49), twice=one.union(one)).collect()}
    assert prints["one"] == prints["two"] and len({*prints.values()}) == 3

"""Queries of nested documents: typed edits, change sets, signals at every path, equality views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import nested
from tracewell.operators import documents
from tracewell.session import once, spread, table

#: A document of each event, and the same with its keys in another order; both engines build them from one text.
_DOC = """concat('{"k": ', CAST(event_id % 7 AS STRING), ', "flag": true, "price": 1.50, "none": null, "o": {"z": "', event_type, '", "a": [1, {"b": "', event_type, '", "a": 2}, [3]]}}')"""
_TURNED = """concat('{"o":{"a":[1,{"a":2,"b":"', event_type, '"},[3]],"z":"', event_type, '"},"price":1.5,"none":null,"k":', CAST(event_id % 7 AS STRING), ',"flag":true}')"""


def _events(spark, d, *columns):
    return table(spark, d, "events").selectExpr("event_id", "event_type", *columns)


def typed_edit(spark, d):
    """Values set and removed at inner paths; the rest keeps its types."""
    v = nested.parsed(F.col("doc"))
    new = nested.with_value(nested.with_value(v, "o.a.1.b", nested.variant(9)), "o.new.0", F.col("event_type").cast("variant"))
    new = nested.without_value(nested.without_value(nested.with_value(new, "o.a.4", nested.variant({"x": False})), "price"), "o.a.0")
    edited = once(spread(_events(spark, d, f"{_DOC} AS doc"), "doc"), new=F.to_json(new))
    return edited.select("event_id", F.col("new").alias("doc"), nested.value_at(F.col("new"), "o.a.1.b").alias("inner"))


def document_predicates(spark, d):
    """Every operator of a where, loose equality and nulls among them."""
    v = nested.parsed(F.col("doc"))
    tests = {"equal": {"k": "3"}, "truth": {"flag": "true", "price": "1.5"}, "null_": {"none": None}, "list_": {"o.a.2": [3]}, "contains": {"o.z$contains": "li"}, "found": {"o.a.1.b.$matches": "^(cl|vi)"}, "in_": {"k.$in": [1, "2", 5]}, "exists": {"none.$exists": True, "o.q.$exists": False}}
    return _events(spark, d, f"{_DOC} AS doc").select("event_id", *(nested.holds(v, w).alias(k) for k, w in tests.items()))


_ITEMS = """concat('{"title": ', CAST(o_custkey AS STRING), ', "items": [{"id": "g', CAST(o_orderkey % 3 AS STRING), '", "field type": "grid", "number of columns": "2", "column widths": "10, 20"}',
', {"id": "b", "n": {"deep": [1, 2], "keep": 1.25}, "gone": 1}', CASE WHEN o_orderkey % 5 = 0 THEN ', {"id": "b", "n": 0}' ELSE '' END, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat(', {"name": "tail', CAST(o_orderkey % 4 AS STRING), '"}') END, ']}')"""
_CHANGES = [
    {"type": "update", "where": {"id": "b"}, "set": {"n.deep.1": 7, "n.new.x": True}, "unset": ["gone"]},
    {"type": "insert", "where": {"name.$exists": True}, "item": {"id": "after", "v": [1]}},
    {"type": "column", "grid": "g1", "width": 30, "heading": "H"},
    {"type": "remove", "where": {"name.$matches": "^tail[12]$", "id.$exists": False}},
]


def change_set(spark, d):
    made = documents.apply_changes(table(spark, d, "orders").selectExpr("o_orderkey AS id", f"{_ITEMS} AS document"), _CHANGES)
    return made.select("id", nested.canonical(F.col("document")).alias("document"), "problem", F.array_join("notes", ";").alias("notes"))


def privacy_paths(spark, d):
    mail = """concat('{"who": {"list": ["plain", {"at": "write to ', event_type, '@example.com"}], "n": 5}, "path": "see /home/', event_type, '"}') AS document"""
    return documents.privacy_signals(_events(spark, d, "event_id AS id", mail).select("id", "document")).select("id", "code", "path", "sample")


def equality_views(spark, d):
    """The same rows with other orders of keys, rows and columns, and one table that differs in a value."""
    as_struct = lambda doc: F.from_json(doc, "k long, flag boolean, price double, none string, o variant")
    one, two = (_events(spark, d, f"{x} AS doc").select("event_id", as_struct(F.col("doc")).alias("row")) for x in (_DOC, _TURNED))
    changed = one.withColumn("event_id", F.when(F.col("event_id") == 0, -1).otherwise(F.col("event_id")))
    found = documents.equality_view(one=one, two=two.select("row", "event_id").orderBy(F.desc("event_id")), three=changed)
    first = found.filter("name = 'one'").select(F.col("fingerprint").alias("f"))  # one row
    return found.crossJoin(first).select("name", "n_rows", (F.col("fingerprint") == F.col("f")).alias("same"))


QUERIES = {f.__name__: f for f in (typed_edit, document_predicates, change_set, privacy_paths, equality_views)}

_UPDATED = """'{"id":"b","n":{"deep":[1,7],"keep":1.25,"new":{"x":true}}}'"""
ORACLES = {
    "typed_edit": """SELECT event_id, '{"flag":true,"k":' || (event_id % 7) || ',"none":null,"o":{"a":[null,{"a":2,"b":9},[3],null,{"x":false}],"new":{"0":"' || event_type || '"},"z":"' || event_type || '"}}' AS doc, '9' AS "inner" FROM events""",
    "document_predicates": "SELECT event_id, event_id % 7 = 3 AS equal, true AS truth, true AS null_, true AS list_, contains(event_type, 'li') AS contains, event_type LIKE 'cl%' OR event_type LIKE 'vi%' AS found, event_id % 7 IN (1, 2, 5) AS in_, true AS exists FROM events",
    "change_set": f"""WITH s AS (SELECT *, o_orderkey % 5 = 0 AS twice, o_orderkey % 4 AS tail, o_orderkey % 3 AS g FROM orders),
p AS (SELECT *, CASE WHEN twice THEN '1:SEVERAL_MATCHES' WHEN tail = 0 THEN '2:NO_MATCH' WHEN g <> 1 THEN '3:NO_MATCH' WHEN tail = 3 THEN '4:NO_MATCH' END AS problem FROM s)
SELECT o_orderkey AS id, problem, CASE WHEN problem IS NULL THEN 'updated b;inserted after after tail' || tail || ';added column 3 to g1;removed tail' || tail ELSE '' END AS notes,
CASE WHEN problem IS NOT NULL THEN '{{"items":[{{"column widths":"10, 20","field type":"grid","id":"g' || g || '","number of columns":"2"}},{{"gone":1,"id":"b","n":{{"deep":[1,2],"keep":1.25}}}}' || CASE WHEN twice THEN ',{{"id":"b","n":0}}' ELSE '' END || CASE WHEN tail > 0 THEN ',{{"name":"tail' || tail || '"}}' ELSE '' END || '],"title":' || o_custkey || '}}'
ELSE '{{"items":[{{"column headings":"H","column widths":"10,20,30","field type":"grid","id":"g1","number of columns":"3"}},' || {_UPDATED} || ',{{"id":"after","v":[1]}},{{"column":"3","field type":"output field","grid":"g1","id":"g1_col3"}}],"title":' || o_custkey || '}}' END AS document FROM p""",
    "privacy_paths": """SELECT event_id AS id, code, path, CASE WHEN path = '$.path' THEN 'see /home/' || event_type ELSE 'write to ' || event_type || '@example.com' END AS sample FROM events, (VALUES ('EMAIL', '$.who.list[1].at'), ('URL_OR_HOST', '$.who.list[1].at'), ('FILE_PATH', '$.path')) t(code, path)""",
    "equality_views": "SELECT name, count(*) AS n_rows, name <> 'three' AS same FROM events, (VALUES ('one'), ('two'), ('three')) t(name) GROUP BY 1",
}

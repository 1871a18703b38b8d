"""Cases of our own in the shapes that the reference tests: guard, search, budgets, statements, sources, snapshots."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import source_lines, sqltext
from tracewell.functions import text as X
from tracewell.operators import budget, context, delta, govern, graph, search
from tracewell.operators.store import SnapshotStore
from tracewell.plans import catalogue, guard
from tracewell.sources import files, sinks


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_guard_reads_only(spark):
    assert guard.read_only(spark, "SELECT 'DROP' AS x -- DELETE\n").first()["x"] == "DROP"
    for bad in ("DROP TABLE x", "INSERT INTO t VALUES (1)", "", "-- only a comment", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"):
        with pytest.raises(ValueError):
            guard.check_read_only(spark, bad)
    assert guard.split_statements("SELECT ';' AS a; /* ; */ SELECT 2;") == ["SELECT ';' AS a", "SELECT 2"]
    assert [d.first()[0] for d in guard.read_only_batch(spark, "SELECT 1; SELECT 2")] == [1, 2]


def test_change_safety_and_identifiers():
    assert guard.weak_predicate("1 = 1") == "ALWAYS_TRUE" and guard.weak_predicate("A = 2 OR 1=1") == "OR_TAUTOLOGY"
    assert guard.weak_predicate("A IS NOT NULL") == "ONLY_NOT_NULL" and guard.weak_predicate("A LIKE '%'") == "LIKE_ANYTHING" and guard.weak_predicate("A = 'OR 1=1'") is None
    assert guard.change_allowed('UPDATE APP.ORDERS SET A = 1', ["orders"]) and not guard.change_allowed("DELETE FROM X.Y WHERE A = 1", ["Z.Y"])
    assert guard.identifier(" ord#1 ") == "ORD#1" and guard.quoted("o'k") == "'o''k'"
    with pytest.raises(ValueError):
        guard.identifier("1X")
    assert guard.page_offset(guard.page_token("t", 40), "t") == 40
    with pytest.raises(ValueError):
        guard.page_offset(guard.page_token("t", 40), "u")


def test_lexical_search_limits_titles_and_filters(spark):
    docs = spark.createDataFrame([(1, "Order entry", "order of goods"), (2, "Stock", "an order here"), (3, "Other", "nothing"), (4, None, None)], "id long, title string, body string")
    found = search.search_documents(docs, "id", "title", "body")
    assert [r["doc_id"] for r in search.lexical_search(found, "order").collect()] == [1, 2]
    assert [r["doc_id"] for r in search.lexical_search(found, "order goods").collect()] == [1]
    assert [r["doc_id"] for r in search.lexical_search(found, "order", keep=F.col("title") == "Stock").collect()] == [2]
    with pytest.raises(ValueError):
        search.lexical_search(found, "order", limit=201)


def test_budget_slices_and_packing(spark):
    assert sum(r["tokens"] for r in budget.budget_slices(spark, 1000).collect()) == 1000
    items = spark.createDataFrame([("a", i, c) for i, c in enumerate((30, 50, 10, 25, 0, 90))], "bucket string, id long, cost long")
    packed = budget.greedy_pack(items, "bucket", [F.col("id")], 60)
    assert sorted(r["id"] for r in packed.collect()) == [0, 2, 4]


def test_statement_relations_keep_terminator_and_lower_confidence(spark):
    rows = [("SELECT A FROM APP.ORDERS O INNER JOIN CUSTOMERS C ON O.ID = C.ID WHERE A = 1 AND B = 2;",), ("SELECT A FROM T1, T2",), ("PREPARE S FROM :X",), (None,)]
    facts = sqltext.statement_facts(spark.createDataFrame(rows, "text string")).collect()
    r = facts[0]["relations"]
    assert (r["driver"], r["confidence"], r["filters"]) == ("ORDERS", "HIGH", ["A = 1", "B = 2;"])
    assert [tuple(j) for j in r["joins"]] == [("CUSTOMERS", "C", "INNER", "O.ID = C.ID")]
    assert facts[1]["relations"]["confidence"] == "MEDIUM" and facts[2]["dynamic"] and facts[2]["relations"] is None and facts[3]["kind"] == "OTHER"


def test_source_corpus(spark):
    corpus = [
        ("a/free.rpgle", "**FREE\ndcl-f WRK disk;\n/COPY QSRC,ORD\nCALL 'SUB';\n"), ("a/fixed.rpg", "     FWRK       IF   E           K DISK\n     C                   EVAL      *INLR = *ON"),
        ("a/mod.rpgle", "**FREE\nctl-opt nomain bnddir('BD') bndsrvpgm('SRV');\n\ndcl-pr Proc extproc('PROC');\nend-pr;\n\ndcl-proc Loc export;\nend-proc;"),
        ("a/srv.bnd", "STRPGMEXP PGMLVL(*CURRENT)\n  EXPORT SYMBOL('LOC')\nENDPGMEXP"), ("a/x.clle", "CALL PGM(LIB/NEXT)\nDLTF FILE(QTEMP/WRK)"), ("a/y.dspf", "     A          R MAIN                      SFLCTL(SUB)\n     A                                      REF(WRK)"), ("a/empty.rpg", ""),
    ]
    facts = source_lines.source_facts(spark.createDataFrame(corpus, "path string, content string"))
    got = {(r["path"], r["fact"], r["name"]) for r in facts.collect()}
    wanted = {
        ("a/free.rpgle", "FILE", "WRK"), ("a/free.rpgle", "COPY", "QSRC,ORD"), ("a/free.rpgle", "CALL", "SUB"), ("a/fixed.rpg", "FILE", "WRK"), ("a/fixed.rpg", "INDICATOR", "LR"), ("a/mod.rpgle", "MODULE", "*SELF"),
        ("a/mod.rpgle", "BINDING_DIRECTORY", "BD"), ("a/mod.rpgle", "SERVICE_PROGRAM", "SRV"), ("a/mod.rpgle", "PROTOTYPE", "PROC"), ("a/mod.rpgle", "PROCEDURE", "LOC"), ("a/srv.bnd", "EXPORT", "LOC"),
        ("a/x.clle", "CALL", "NEXT"), ("a/x.clle", "OBJECT", "WRK"), ("a/y.dspf", "RECORD", "MAIN"), ("a/y.dspf", "REFERENCE", "WRK"),
    }
    assert wanted <= got
    assert [r["level"] for r in source_lines.export_levels(facts).collect()] == ["CURRENT"]


def test_graph_hops_cycles_and_order(spark):
    edges = spark.createDataFrame([("A", "B", "X"), ("B", "C", "X"), ("C", "D", "X"), ("D", "A", "X")], "src string, dst string, type string")
    seed = spark.createDataFrame([("A",)], "node string")
    assert {r["node"] for r in graph.closure(edges, seed, 2).collect()} == {"A", "B", "C"}
    assert {r["node"] for r in graph.impact(edges, "A").filter("scope = 'indirect'").collect()} == {"A", "B", "C"}
    assert graph.topological_order({"b": ["a"], "a": [], "c": ["b"]}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        graph.topological_order({"a": ["b"], "b": ["a"]})


def test_snapshot_diff_treats_null_as_empty(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "k long, v string, w string")
    after = spark.createDataFrame([(1, "a", ""), (2, "b2", "x"), (4, "d", None)], "k long, v string, w string")
    diff = delta.snapshot_diff(before, after, ["k"])
    assert {(r["key_text"], r["change"]) for r in diff.collect()} == {("2", "UPDATED"), ("3", "DELETED"), ("4", "INSERTED")}
    undo = {r["key_text"]: r["statement"] for r in delta.rollback_statements(diff, "S.T", "k").collect()}
    assert undo["2"] == "UPDATE S.T SET v = 'b' WHERE k = 2;" and undo["4"] == "DELETE FROM S.T WHERE k = 4;"


def test_incremental_store_equals_full(spark, tmp_path):
    def units(rows):
        df = spark.createDataFrame(rows, "path string, content string")
        return df.select(F.lit("r").alias("root"), "path", X.content_hash(F.col("content")).alias("hash"), "content")

    one = [("a.rpgle", "dcl-f A disk;"), ("b.rpgle", "dcl-f B disk;"), ("c.rpgle", "CALL 'X';")]
    two = [("a.rpgle", "dcl-f A disk;"), ("b.rpgle", "dcl-f B2 disk;"), ("d.rpgle", "CALL 'Y';")]
    grown = SnapshotStore(spark, str(tmp_path / "grown"))
    assert grown.full(units(one), source_lines.source_facts) == 1
    assert grown.incremental(units(two), source_lines.source_facts) == 2 and grown.incremental(units(two), source_lines.source_facts) == 2
    fresh = SnapshotStore(spark, str(tmp_path / "fresh"))
    fresh.full(units(two), source_lines.source_facts)
    assert values(grown.facts(2)) == values(fresh.facts(1)) and grown.verify(2).isEmpty()


def test_two_roots_and_canonical_hashes(spark, tmp_path):
    def units(rows):
        df = spark.createDataFrame(rows, "root string, path string, content string")
        return df.select("root", "path", X.content_hash(F.col("content")).alias("hash"), "content")

    one = [("r", "a.rpgle", "dcl-f A disk;"), ("s", "a.rpgle", "dcl-f B disk;\r\n")]
    two = [("r", "a.rpgle", "dcl-f A disk;"), ("s", "a.rpgle", "dcl-f C disk;\r\n")]
    store = SnapshotStore(spark, str(tmp_path / "two"))
    store.full(units(one), source_lines.source_facts)
    assert store.incremental(units(two), source_lines.source_facts) == 2
    assert sorted((r["root"], r["path"], r["name"]) for r in store.facts(2).collect()) == [("r", "a.rpgle", "A"), ("s", "a.rpgle", "C")]
    assert store.verify(2).isEmpty()
    claims = units(two).select("path", "hash").filter(F.col("path") == "a.rpgle").limit(1)
    assert {r["status"] for r in context.verified_sources(units(two).filter("root = 'r'"), claims).collect()} == {"OK"}


def test_snapshot_diff_by_two_keys_and_repeated_keys(spark):
    kinds = "a string, b string, v string"
    before = spark.createDataFrame([("a|b", "c", "1"), ("x", "y", "1"), ("x", "y", "2")], kinds)
    after = spark.createDataFrame([("a", "b|c", "1"), ("x", "y", "1"), ("x", "y", "3")], kinds)
    diff = delta.snapshot_diff(before, after, ["a", "b"])
    got = {(tuple(r["keys"]), r["change"], r["statement"]) for r in diff.join(delta.rollback_statements(diff, "T", "a", "b"), ["key_text", "change"]).collect()}
    assert got == {
        (("a", "b|c"), "INSERTED", "DELETE FROM T WHERE a = 'a' AND b = 'b|c';"),
        (("a|b", "c"), "DELETED", "INSERT INTO T (a, b, v) VALUES ('a|b', 'c', 1);"),
        (("x", "y"), "UPDATED", "UPDATE T SET v = 2 WHERE a = 'x' AND b = 'y';"),
    }


def test_packing_keeps_string_ids(spark):
    items = spark.createDataFrame([("k", "x1", 5), ("k", "x2", 9), ("k", "x3", 4)], "bucket string, id string, cost long")
    assert sorted(r["id"] for r in budget.greedy_pack(items, "bucket", [F.col("id")], 9).collect()) == ["x1", "x3"]


def test_guard_refuses_code_and_paths(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("guarded")
    spark.range(3).write.parquet(f"{tmp_path}/t")
    good = "WITH c AS (SELECT id FROM guarded) SELECT id, (SELECT max(id) FROM c) AS m FROM c WHERE id IN (SELECT id FROM guarded)"
    assert guard.read_only(spark, good).count() == 3
    for bad in (
        "SELECT reflect('java.lang.System', 'currentTimeMillis')", "SELECT id FROM guarded WHERE id < (SELECT java_method('java.lang.Math', 'abs', -1))",
        f"SELECT * FROM parquet.`{tmp_path}/t`", f"SELECT id FROM guarded WHERE id IN (SELECT id FROM parquet.`{tmp_path}/t`)",
        f"WITH c AS (SELECT * FROM parquet.`{tmp_path}/t`) SELECT * FROM c", "WITH c AS (SELECT try_reflect('java.lang.Math', 'abs', -1)) SELECT * FROM c",
    ):
        with pytest.raises(ValueError):
            guard.read_only(spark, bad)


def test_files_sinks_and_policies(spark, tmp_path):
    (tmp_path / "src/sub").mkdir(parents=True)
    (tmp_path / "src/a.rpgle").write_text("x\r\ny")
    (tmp_path / "src/sub/b.clle").write_text("z")
    (tmp_path / "src/.hidden.rpgle").write_text("h")
    (tmp_path / "src/c.bin").write_text("n")
    found = files.scan(spark, str(tmp_path / "src"))
    assert sorted(r["path"] for r in found.collect()) == ["a.rpgle", "sub/b.clle"]
    inv = files.inventory(found, "r")
    assert {(r["path"], r["newlines"]) for r in inv.collect()} == {("a.rpgle", "CRLF"), ("sub/b.clle", "NONE")}
    sinks.export_snapshot(inv, str(tmp_path / "out"))
    assert sinks.import_snapshot(spark, str(tmp_path / "out")).count() == 2
    assert "a.rpgle" in sinks.ascii_table(inv.select("path"))
    record = spark.range(1).select(files.fixed_records(F.concat(F.rpad(F.lit("A"), 80, " "), F.rpad(F.lit("B"), 80, " "))).alias("r")).first()["r"]
    assert record == ["A", "B"]
    masks = govern.merged_masks(["email"], [{"table": "T", "columns": ["PHONE"], "value": "P"}], "S", "T")
    row = govern.masked(spark.createDataFrame([("a", None, "b")], "EMAIL string, phone string, z string"), masks).first()
    assert tuple(row) == ("MASKED", None, "b")
    assert context.verified_sources(spark.createDataFrame([("p", "c")], "path string, content string"), spark.createDataFrame([("p", "x"), ("q", "y")], "path string, hash string")).orderBy("path").collect()[1]["status"] == "MISSING"


def test_streamed_counts_equal_batch(spark, tmp_path):
    from tracewell.streaming.incremental import event_counts

    rows = spark.sql("SELECT id AS event_id, timestamp_seconds(id * 60) AS ts, if(id % 2 = 0, 'a', 'b') AS event_type, cast(id AS double) AS value FROM range(50)")
    rows.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events"))
    q = event_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert values(spark.table("counts")) == values(event_counts(rows))


def test_every_event_is_edited(spark, tmp_path):
    rows = [(k, "view", f'{{"k": {k % 7}}}') for k in (0, 499, 500, 501, 123_456)]
    spark.createDataFrame(rows, "event_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = catalogue.queries()["json_edit"](spark, str(tmp_path)).select("event_id", "tag", "k", "n_left")
    assert values(found) == sorted(((k, "view", str(k % 7), 1) for k, _, _ in rows), key=repr)


def test_text_scalars_see_whole_texts(spark, tmp_path):
    head = "x" * 60
    texts = [f"{head}a", f"{head}b", "  " + "w " * 2000 + " " * 1000, "", None, "é😀 " * 500, "\n" + head * 30 + " "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def rolling(text):
        h = 0
        units = text.encode("utf-16-be")
        for k in range(0, len(units), 2):
            h = (h * 31 + units[k] * 256 + units[k + 1]) % (1 << 32)
        return format(abs(h - (1 << 32) if h >= 1 << 31 else h), "x")

    def saved(text):
        return int((len(text) - len(text.strip(" "))) * 100 / len(text) + 0.5) if text else 0

    rows = {r["doc_id"]: r for r in catalogue.queries()["text_scalars"](spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) and rows[0]["rolling"] != rows[1]["rolling"]
    for k, text in enumerate(texts):
        assert (rows[k]["rolling"], rows[k]["saved"]) == (None if text is None else rolling(text), saved(text))


def test_lookups_take_every_member_and_export(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("customer", [(90, 0), (120, 1), (79, 3)], "c_custkey long, c_nationkey int")
    write("orders", [(1, 0), (2, 19), (3, 35)], "o_orderkey long, o_custkey long")
    write("part", [(1000, 0)], "p_partkey long, p_size int")
    write("lineitem", [(7, 13), (7, 25)], "l_suppkey long, l_partkey long")
    callees = catalogue.queries()["callee_resolution"](spark, str(tmp_path)).select("caller", "status", "path")
    assert values(callees) == [(1, "ambiguous", None), (2, "resolved", "/src/38"), (3, "unresolved", None)]
    bound = catalogue.queries()["binding_summary"](spark, str(tmp_path)).select("program", "n_imports", "n_bound", "unresolved")
    assert values(bound) == [(7, 2, 1, "P25")]


def test_pseudonyms_stay_distinct_beyond_three_digits(spark):
    rows = spark.range(1, 10_012).select(F.lit("a").alias("category"), F.concat(F.lit("v"), "id").alias("value"), F.col("id").alias("seen"))
    found = {r["value"]: r["placeholder"] for r in govern.pseudonyms(rows, "category", "value", "seen").collect()}
    assert found == {f"v{k}": f"A_{k:03d}" for k in range(1, 10_012)}

"""Bytes and their encodings, source status, manifests, sinks, paths and export levels."""

import hashlib
import json

from pyspark.sql import functions as F

from tracewell.functions import source_lines
from tracewell.sources import files, sinks

TEXT = "naïve 日本 🙂\r\nend"


def test_encodings_are_told_from_bytes(spark):
    cases = [
        (TEXT.encode(), "UTF-8", False, TEXT), (b"\xef\xbb\xbf" + TEXT.encode(), "UTF-8", True, TEXT), (b"\xff\xfe" + TEXT.encode("utf-16-le"), "UTF-16LE", True, TEXT), (b"\xfe\xff" + TEXT.encode("utf-16-be"), "UTF-16BE", True, TEXT),
        (b"", "UTF-8", False, ""), (b"\xff\xfe", "UTF-16LE", True, ""), (b"\xef\xbb\xbf", "UTF-8", True, ""), (b"\xc3\x28", None, False, None), (b"\xef\xbb\xbf\xc3\x28", None, False, None), (b"\xff\xfea", None, False, None),
        (b"\xff\xfe\x00\xd8a\x00", None, False, None), (b"\xff\xfe\x00\xdc", None, False, None), (b"\xfe\xff\xd8\x3d", None, False, None), (b"\xfe\xff\x00\xd8\x00\xdc", "UTF-16BE", True, "ØÜ"), (b"\xff\xfe" + "a🙂b".encode("utf-16-le", "surrogatepass"), "UTF-16LE", True, "a🙂b"),
    ]
    df = spark.createDataFrame([(str(k), len(raw), bytearray(raw)) for k, (raw, *_) in enumerate(cases)], "path string, size long, bytes binary")
    got = {int(r["path"]): (r["encoding"], r["had_bom"], r["content"]) for r in files.decoded(df).collect()}
    assert got == {k: tuple(wanted) for k, (_, *wanted) in enumerate(cases)}
    strict = {int(r["path"]): r["encoding"] for r in files.decoded(df, utf8_only=True).collect()}
    assert strict[2] is None and strict[1] == "UTF-8"


def test_a_folder_of_encodings(spark, tmp_path):
    for name, raw in {"a.sql": b"\xff\xfe" + "x\r\ny".encode("utf-16-le"), "b.sql": b"\xc3\x28", "c.sql": b"plain\n", "d.sql": b"old\rmac"}.items():
        (tmp_path / name).write_bytes(raw)
    read = files.scan_bytes(spark, str(tmp_path))
    assert {r["path"]: r["content"] for r in files.scan(spark, str(tmp_path)).collect()} == {"a.sql": "x\r\ny", "b.sql": None, "c.sql": "plain\n", "d.sql": "old\rmac"}
    plain = hashlib.sha256(b"plain\n").hexdigest()
    expected = spark.createDataFrame([("a.sql", None), ("c.sql", plain), ("d.sql", plain), ("gone.sql", plain)], "path string, sha256 string")
    got = {r["path"]: (r["status"], r["encoding"], r["newlines"], r["issues"]) for r in files.source_status(read, expected).collect()}
    assert got == {
        "a.sql": ("normalized", "UTF-16LE", "CRLF", ["SOURCE_BOM_REMOVED", "SOURCE_ENCODING_CONVERTED", "SOURCE_LINE_ENDINGS_NORMALIZED"]), "b.sql": ("invalid", None, "UNKNOWN", ["INVALID_UTF8"]), "c.sql": ("valid", "UTF-8", "LF", []),
        "d.sql": ("invalid", "UTF-8", "CR", ["LEGACY_CR_NEWLINES", "SOURCE_CHANGED_SINCE_IMPORT", "SOURCE_LINE_ENDINGS_NORMALIZED"]), "gone.sql": ("invalid", None, "UNKNOWN", ["SOURCE_FILE_MISSING"]),
    }


def test_integrity_against_a_manifest(spark, tmp_path):
    text = spark.createDataFrame([("a", 3, "x\ny"), ("b", 1, "z"), ("c", 4, "x\r\ny\n")], "path string, size long, content string")
    right = {r["path"]: r["hash"] for r in files.inventory(text, "r").collect()}
    (tmp_path / "m.json").write_text(json.dumps({"files": [{"path": "a", "hash": right["a"]}, {"path": "b", "hash": "0"}, {"path": "c", "hash": right["c"]}, {"path": "d", "hash": "1"}]}, indent=1))
    found = files.integrity(text, files.read_manifest(spark, f"{tmp_path}/m.json"))
    assert {(r["path"], r["issue"]) for r in found.collect()} == {("b", "HASH_MISMATCH"), ("c", "MIXED_NEWLINES"), ("d", "MISSING")}


def test_sinks(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, 'a "q"; b'), (2, None)], "id int, t string").coalesce(1), f"{tmp_path}/csv")
    lines = next((tmp_path / "csv").glob("part-*.csv")).read_text().splitlines()
    assert lines[0] == '"id";"t"' and lines[1].startswith('"1";"a ') and len(lines) == 3
    one = spark.sql("SELECT 1 AS b, named_struct('y', 1, 'x', named_struct('q', 2, 'p', 3)) AS a")
    two = spark.sql("SELECT named_struct('x', named_struct('p', 3, 'q', 2), 'y', 1) AS a, 1 AS b")
    assert sinks.fingerprinted_json(one).collect() == sinks.fingerprinted_json(two).collect()
    assert sinks.fingerprinted_json(one).first()["json"] == '{"a":{"x":{"p":3,"q":2},"y":1},"b":1}'


def test_paths_and_levels(spark):
    paths = {"a/b.c": True, "": False, "/a": False, "\\a": False, "C:a": False, "../a": False, "a/../b": False, "a..b/c": True, "a/..": False}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", files.safe_path(F.col("p")).alias("ok")).collect()
    assert {r["p"]: r["ok"] for r in got} == paths
    text = "EXPORT SYMBOL('EARLY')\nSTRPGMEXP PGMLVL(*CURRENT)\nEXPORT SYMBOL('NEW')\nENDPGMEXP\nSTRPGMEXP PGMLVL(*PRV)\nEXPORT SYMBOL('OLD')\n"
    facts = source_lines.source_facts(spark.createDataFrame([("s.bnd", text)], "path string, content string"))
    assert {(r["name"], r["level"]) for r in source_lines.export_levels(facts).collect()} == {("EARLY", None), ("NEW", "CURRENT"), ("OLD", "PRV")}

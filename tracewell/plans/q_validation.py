"""The query of candidate validation: a candidate of each order, evidence of each customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import validation
from tracewell.session import table

#: A candidate's parts, as both engines build them from an order; `kind` says what is wrong with it.
_PARTS = """SELECT o_orderkey AS id, o_orderkey % 15 AS kind, 'e' || CAST(o_custkey AS STRING) AS ref, 'src/p' || CAST(o_orderkey AS STRING) AS base FROM orders"""
_FILE = """CASE kind WHEN 3 THEN '../' || base || '.sql' WHEN 4 THEN 'C:/' || base || '.sql' WHEN 5 THEN base || '.exe' WHEN 7 THEN 'other/x.rpgle' WHEN 13 THEN 'src/nul.sql' ELSE base || '.rpgle' END"""
_DOC = f"""CASE WHEN kind = 1 THEN 'no json' ELSE concat('{{"schemaVersion": ', CASE WHEN kind = 2 THEN '2' ELSE '1' END, ', "candidateId": "', CASE WHEN kind = 14 THEN '' ELSE 'c' END, '", "proposedFiles": [{{"path": "', {_FILE}, '", "action": "', CASE WHEN kind = 11 THEN 'burn' ELSE 'create' END,
'", "content": "', CASE WHEN kind = 10 THEN 'token = ''abcdefghijk''' WHEN kind = 12 THEN 'a\\\\u0000b' ELSE 'x' END, '"}}', CASE WHEN kind = 6 THEN concat(', {{"path": "SRC\\\\\\\\P', CAST(id AS STRING), '.RPGLE"}}') ELSE '' END, '], "evidenceReferences": [', CASE WHEN kind = 8 THEN '' WHEN kind = 9 THEN concat('{{"id": "q", "kind": "source"}}, {{"id": "', ref, '", "kind": "test"}}') ELSE concat('{{"id": "', ref, '", "kind": "source"}}') END, ']}}') END"""


def candidate_validation(spark, d):
    orders = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 15 AS kind", "'e' || CAST(o_custkey AS STRING) AS ref", "'src/p' || CAST(o_orderkey AS STRING) AS base")
    evidence = table(spark, d, "customer").selectExpr("'e' || CAST(c_custkey AS STRING) AS id", "'source' AS kind")
    found = validation.validate(orders.selectExpr("id", f"{_DOC} AS document"), evidence, validation.Policy(scope=("src",)))
    shown = F.array_join(F.transform("diagnostics", lambda x: F.concat(x["rule"], F.lit(":"), x["code"], F.lit("@"), F.coalesce(x["path"], F.lit("")))), ";")
    return found.select("id", "status", "ready", F.size("ran").cast("long").alias("n_rules"), shown.alias("diagnostics"))


QUERIES = {"candidate_validation": candidate_validation}
ORACLES = {
    "candidate_validation": f"""WITH c AS ({_PARTS}), k AS (SELECT *, ref IN (SELECT 'e' || c_custkey FROM customer) AS known FROM c),
f AS (SELECT id, kind, CASE kind WHEN 1 THEN 'schema:SCHEMA_INVALID@/' WHEN 14 THEN 'schema:SCHEMA_INVALID@/candidateId' ELSE concat_ws(';',
 CASE WHEN kind = 2 THEN 'contract-version:CONTRACT_VERSION_UNSUPPORTED@/schemaVersion' END, CASE WHEN kind = 6 THEN 'duplicate-target:DUPLICATE_TARGET@SRC\\P' || id || '.RPGLE' END, CASE WHEN kind = 8 THEN 'evidence-reference:EVIDENCE_MISSING@/evidenceReferences' END,
 CASE WHEN kind = 9 AND known THEN 'evidence-reference:EVIDENCE_TYPE_MISMATCH@/evidenceReferences/' || ref END, CASE WHEN NOT known AND kind NOT IN (8) THEN 'evidence-reference:EVIDENCE_UNKNOWN@/evidenceReferences/' || ref END, CASE WHEN kind = 9 THEN 'evidence-reference:EVIDENCE_UNKNOWN@/evidenceReferences/q' END,
 CASE WHEN kind = 5 THEN 'file-type:FILE_TYPE_DENIED@' || base || '.exe' END, CASE kind WHEN 3 THEN 'workspace-path:PATH_UNSAFE@../' || base || '.sql' WHEN 4 THEN 'workspace-path:PATH_UNSAFE@C:/' || base || '.sql' WHEN 13 THEN 'workspace-path:PATH_UNSAFE@src/nul.sql' END,
 CASE WHEN kind = 11 THEN 'policy:POLICY_DENIED@' || base || '.rpgle' END, CASE WHEN kind = 6 THEN 'scope:SCOPE_EXPANSION@SRC/P' || id || '.RPGLE' WHEN kind = 7 THEN 'scope:SCOPE_EXPANSION@other/x.rpgle' END, CASE WHEN kind = 10 THEN 'policy:SECRET_LIKE_CONTENT@' || base || '.rpgle' END,
 CASE WHEN kind = 12 THEN 'static-parse:STATIC_PARSE_FAILED@' || base || '.rpgle' END) END AS diagnostics FROM k)
SELECT id, CASE WHEN kind IN (10, 11) THEN 'denied' WHEN kind IN (1, 2, 14) THEN 'invalid' WHEN diagnostics <> '' THEN 'validation-failed' ELSE 'review-ready' END AS status, diagnostics = '' AS ready, CASE WHEN kind IN (1, 14) THEN 1 WHEN kind IN (3, 4, 5, 13) THEN 9 ELSE 10 END::BIGINT AS n_rules, diagnostics FROM f""",
}

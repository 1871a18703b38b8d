"""Queries of symbols and their relationships, over units and mentions derived from suppliers and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import symbols
from tracewell.session import table

_UNITS = {"root": "'r' || CAST(s_nationkey % 3 AS STRING)", "path": "'src/p' || CAST(s_suppkey % 60 AS STRING) || '.rpgle'", "hash": "'h' || CAST(s_nationkey % 3 AS STRING) || CAST(s_suppkey % 60 AS STRING)", "family": "CASE WHEN s_suppkey % 60 % 10 = 9 THEN 'BND' ELSE 'RPG' END"}
_KINDS = ("PROCEDURE", "PROTOTYPE", "FILE", "CALL", "PROCEDURE_CALL", "COPY", "TABLE", "STRUCTURE", "SERVICE_PROGRAM", "OTHER")
_MENTIONS = {
    "root": "'r' || CAST(s_nationkey % 3 AS STRING)", "path": "'src/p' || CAST(s_suppkey % 60 AS STRING) || '.rpgle'", "line": "l_orderkey", "kind": f"CASE (l_partkey + l_linenumber) % 10 {' '.join(f'WHEN {i} THEN {chr(39)}{k}{chr(39)}' for i, k in enumerate(_KINDS))} END",
    "name": "CASE (l_partkey + l_linenumber) % 10 WHEN 3 THEN 'p' || CAST(l_orderkey % 75 AS STRING) WHEN 4 THEN ' Do' || CAST(l_partkey % 60 AS STRING) WHEN 0 THEN 'do' || CAST(l_partkey % 45 AS STRING) ELSE 'n' || CAST(l_partkey % 30 AS STRING) END",
    "owner": "CASE WHEN l_linenumber % 2 = 0 THEN 'do' || CAST(l_suppkey % 45 AS STRING) ELSE NULL END",
}


def _graph(spark, d) -> symbols.SymbolGraph:
    units = table(spark, d, "supplier").selectExpr(*(f"{x} AS {c}" for c, x in _UNITS.items())).distinct()
    met = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return symbols.symbol_graph(units, met.selectExpr(*(f"{x} AS {c}" for c, x in _MENTIONS.items())))


def symbol_table(spark, d):
    return _graph(spark, d).symbols


def symbol_relationships(spark, d):
    return _graph(spark, d).relationships


def unresolved_symbols(spark, d):
    return _graph(spark, d).unresolved


QUERIES = {f.__name__: f for f in (symbol_table, symbol_relationships, unresolved_symbols)}

_WITH = f"""WITH u AS (SELECT DISTINCT root, path, root || ':' || path AS unit, hash, family, upper(regexp_extract(path, '([^/]*)[.]rpgle$', 1)) AS name FROM (SELECT {', '.join(f'{x} AS {c}' for c, x in _UNITS.items())} FROM supplier)),
m0 AS (SELECT {', '.join(f'{x} AS {c}' for c, x in _MENTIONS.items())} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
m AS (SELECT m0.root, u.unit, u.hash, line, kind, upper(trim(m0.name)) AS name, upper(owner) AS owner FROM m0 JOIN u ON u.root = m0.root AND u.path = m0.path),
pg AS (SELECT 'sym:program:' || unit AS id, name, root, unit, hash, CASE family WHEN 'BND' THEN 'SERVICE_PROGRAM' ELSE 'PROGRAM' END AS kind FROM u),
pr AS (SELECT DISTINCT 'sym:proc:' || unit || ':' || name AS id, name, root, unit FROM m WHERE kind = 'PROCEDURE'),
c AS (SELECT m.*, 'sym:program:' || unit AS src, coalesce((SELECT min(id) FROM pg WHERE pg.kind = 'PROGRAM' AND pg.name = m.name AND pg.root = m.root), (SELECT min(id) FROM pg WHERE pg.kind = 'PROGRAM' AND pg.name = m.name)) AS found, 'program' AS what FROM m WHERE kind = 'CALL'),
b AS (SELECT m.*, coalesce((SELECT min(id) FROM pr WHERE pr.unit = m.unit AND pr.name = m.owner), 'sym:program:' || unit) AS src, coalesce((SELECT min(id) FROM pr WHERE pr.unit = m.unit AND pr.name = m.name), (SELECT min(id) FROM pr WHERE pr.root = m.root AND pr.name = m.name), (SELECT min(id) FROM pr WHERE pr.name = m.name)) AS found, 'proc' AS what FROM m WHERE kind = 'PROCEDURE_CALL'),
r AS (SELECT *, coalesce(found, 'sym:unresolved:' || what || ':' || name) AS dst, found IS NULL AS lost FROM (SELECT * FROM c UNION ALL SELECT * FROM b)),
t(mention, short, kind, derivation, confidence, shared, type) AS (VALUES ('PROCEDURE', 'proc', 'PROCEDURE', 'VERIFIED', 'high', false, NULL), ('PROTOTYPE', 'proto', 'PROTOTYPE', 'VERIFIED', 'high', false, NULL), ('STRUCTURE', 'ds', 'DATA_STRUCTURE', 'VERIFIED', 'medium', false, NULL),
 ('FILE', 'file', 'FILE', 'INFERRED', 'medium', true, 'FILE_READ'), ('TABLE', 'table', 'TABLE', 'INFERRED', 'medium', true, 'SQL_REFERENCE'), ('COPY', 'copy', 'COPY_MEMBER', 'VERIFIED', 'high', true, 'COPY_INCLUDE'), ('SERVICE_PROGRAM', 'srvpgm', 'SERVICE_PROGRAM', 'INFERRED', 'medium', true, 'SERVICE_PROGRAM_IMPORT')),
d AS (SELECT 'sym:' || short || ':' || CASE WHEN shared THEN '' ELSE unit || ':' END || m.name AS id, m.name, t.kind, unit, hash, derivation, confidence, line, shared, type FROM m JOIN t ON mention = m.kind),
s AS (SELECT id, name, kind, unit, hash, 'VERIFIED' AS derivation, 'high' AS confidence, NULL::BIGINT AS line FROM pg UNION ALL SELECT id, name, kind, unit, hash, derivation, confidence, line FROM d
 UNION ALL SELECT dst, name, 'UNRESOLVED_SYMBOL', unit, hash, 'UNRESOLVED', 'low', line FROM r WHERE lost)"""
ORACLES = {
    "symbol_table": f"{_WITH} SELECT id, name, kind, unit, hash, derivation, confidence, line, n_places FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY unit, coalesce(line, 0)) AS k FROM s) JOIN (SELECT id, count(DISTINCT CASE WHEN line IS NOT NULL THEN {{'u': unit, 'l': line}} END) AS n_places FROM s GROUP BY 1) USING (id) WHERE k = 1",
    "symbol_relationships": f"{_WITH} SELECT DISTINCT concat_ws('|', 'rel', type, src, dst) AS id, * FROM (SELECT type, 'sym:program:' || unit AS src, id AS dst, unit, hash, derivation, confidence FROM d WHERE shared UNION ALL SELECT CASE WHEN lost THEN 'DYNAMIC_UNRESOLVED_CALL' WHEN what = 'proc' THEN 'BOUND_PROCEDURE_CALL' ELSE 'PROGRAM_CALL' END, src, dst, unit, hash, CASE WHEN lost THEN 'UNRESOLVED' ELSE 'INFERRED' END, CASE WHEN lost THEN 'low' WHEN what = 'proc' THEN 'medium' ELSE 'high' END FROM r)",
    "unresolved_symbols": f"{_WITH} SELECT DISTINCT CASE what WHEN 'proc' THEN 'PROCEDURE_CALL' ELSE 'PROGRAM_CALL' END AS kind, name, src FROM r WHERE lost",
}

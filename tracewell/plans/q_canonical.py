"""Queries of the canonical model, over a scan that is derived from orders, line items, customers, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import canonical
from tracewell.session import table


def _p(x: str, n: int = 90) -> str:
    return f"' p' || CAST({x} % {n} AS STRING)"


def _n(prefix: str, x: str, n: int) -> str:
    return f"'{prefix}' || CAST({x} % {n} AS STRING)"


_ORDER = {"program": _p("o_custkey"), "file": _n("f", "o_orderkey", 3), "line": "o_orderkey"}
_ITEM = {"program": _p("l_suppkey"), "file": _n("f", "l_partkey", 3), "line": "l_orderkey"}
_KIND = "CASE l_linenumber % 3 WHEN 0 THEN 'PROGRAM' WHEN 1 THEN 'PROCEDURE' ELSE 'SUBROUTINE' END"
#: Tables of the scan: from which table, which rows, and expressions that both engines read alike.
SCAN = {
    "sources": ("customer", "true", {"program": _p("c_custkey"), "path": "'src/' || CAST(c_custkey AS STRING)"}),
    "tables": ("orders", "o_orderstatus = 'O'", _ORDER | {"name": _n(" t", "o_orderkey", 40), "line": "o_orderkey % 50"}),
    "native_files": ("orders", "o_orderstatus <> 'P'", _ORDER | {"name": _n("F", "o_orderkey", 14), "kind": "CASE o_orderkey % 8 WHEN 0 THEN 'DISK' WHEN 1 THEN 'printer' WHEN 2 THEN 'WORKSTN' ELSE NULL END", "keyed": "o_orderkey % 2 = 0", "access": "CASE o_orderstatus WHEN 'O' THEN 'READ' ELSE 'UPDATE' END"}),
    "calls": ("orders", "true", _ORDER | {"name": _n("p", "o_orderkey", 120), "kind": "CASE WHEN o_orderkey % 5 > 0 THEN 'program' ELSE NULL END"}),
    "copies": ("orders", "o_orderstatus = 'F'", _ORDER | {"name": "CASE WHEN o_orderkey % 9 = 0 THEN '  ' ELSE " + _n("cpy", "o_orderkey", 6) + " END", "line": "o_orderkey % 7"}),
    "procedures": ("lineitem", "l_returnflag = 'A'", _ITEM | {"name": _n("r", "l_partkey", 25), "kind": "CASE l_partkey % 2 WHEN 0 THEN 'PROCEDURE' ELSE 'SUBROUTINE' END", "exported": "l_linestatus = 'F' AND l_partkey % 3 = 0"}),
    "prototypes": ("lineitem", "l_returnflag = 'R'", _ITEM | {"name": _n("r", "l_partkey", 45), "imported": "l_partkey % 2 = 0", "external": "CASE WHEN l_partkey % 45 > 30 THEN " + _n("x", "l_partkey", 45) + " ELSE NULL END"}),
    "modules": ("supplier", "true", {"program": _p("s_suppkey"), "file": _n("f", "s_suppkey", 3), "line": "s_suppkey", "name": _n("m", "s_suppkey", 4), "kind": "CASE WHEN s_suppkey % 3 = 0 THEN 'nomain_module' ELSE NULL END"}),
    "bindings": ("lineitem", "true", {"program": _p("l_suppkey"), "module": _n("m", "l_suppkey", 4), "file": _n("f", "l_suppkey", 3), "kind": "CASE l_linenumber % 3 WHEN 0 THEN 'BINDING_DIRECTORY' WHEN 1 THEN 'SERVICE_PROGRAM' ELSE 'IMPORT' END", "name": _n("r", "l_partkey", 60)}),
    "exports": ("part", "true", {"name": _n("srv", "p_partkey", 20), "file": "'bnd'", "line": "p_partkey", "symbol": _n("R", "p_size", 60), "level": "CASE WHEN p_partkey % 20 = 3 THEN 'prv' ELSE NULL END"}),
    "statements": ("orders", "true", _ORDER | {"number": "o_orderkey", "kind": "CASE o_orderstatus WHEN 'O' THEN 'select' ELSE 'UPDATE' END", "intent": "CASE o_orderstatus WHEN 'O' THEN 'READ' ELSE 'WRITE' END", "reads": "o_orderstatus = 'O'", "writes": "o_orderstatus <> 'O'", "dynamic": "o_orderkey % 11 = 0", "unresolved": "o_orderkey % 13 = 0", "driver": "CASE WHEN o_orderkey % 3 > 0 THEN " + _n("t", "o_custkey", 17) + " ELSE NULL END", "confidence": "CASE WHEN o_orderkey % 4 = 0 THEN 'LOW' ELSE 'HIGH' END"}),
    "statement_tables": ("lineitem", "l_linenumber < 4", {"program": _p("l_suppkey"), "number": "l_orderkey", "name": _n("t", "l_partkey", 17)}),
    "statement_joins": ("lineitem", "l_linenumber > 3", {"program": _p("l_suppkey"), "number": "l_orderkey", "place": "l_linenumber", "name": _n("t", "l_partkey", 19), "type": "CASE WHEN l_partkey % 2 = 0 THEN 'left' ELSE NULL END", "condition": "CASE WHEN l_partkey % 3 = 0 THEN 'A = B' ELSE NULL END"}),
    "procedure_calls": ("lineitem", "l_linestatus = 'O'", _ITEM | {"owner_kind": _KIND, "owner": _n("r", "l_orderkey", 25), "name": _n("r", "l_partkey", 70), "dynamic": "l_partkey % 70 > 60"}),
    "accesses": ("lineitem", "l_linestatus = 'F'", _ITEM | {"owner_kind": _KIND, "owner": _n("r", "l_orderkey", 25), "opcode": "CASE l_linenumber WHEN 1 THEN 'CHAIN' WHEN 2 THEN 'read' WHEN 3 THEN 'WRITE' WHEN 4 THEN 'UPDATE' WHEN 5 THEN 'EXFMT' WHEN 6 THEN 'BOGUS' ELSE 'SETLL' END", "target": "CASE WHEN l_partkey % 3 = 0 THEN " + _n("fmt", "l_partkey", 4) + " ELSE " + _n("f", "l_partkey", 14) + " END"}),
    "features": ("part", "true", {"program": _p("p_partkey"), "kind": "CASE p_size % 4 WHEN 0 THEN 'BUILT_IN' WHEN 1 THEN 'INDICATOR' WHEN 2 THEN 'STRUCTURE' ELSE 'VARIABLE' END", "name": _n("v", "p_size", 9)}),
}


def _scan(spark, d) -> canonical.Scan:
    return canonical.Scan(**{name: table(spark, d, t).filter(test).selectExpr(*(f"{x} AS {c}" for c, x in columns.items())) for name, (t, test, columns) in SCAN.items()})


def canonical_relations(spark, d):
    r = canonical.relations(_scan(spark, d))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return r.select("program", "id", "type", "src", "dst", shown.alias("attributes"), "n_evidence", "file", "line")


def canonical_entities(spark, d):
    return canonical.entities(_scan(spark, d))


def canonical_evidence(spark, d):
    return canonical.evidence(_scan(spark, d)).groupBy("program", "id").agg(F.count(F.lit(1)).alias("n"), F.max("place").cast("long").alias("last"), F.max_by(F.concat_ws(":", "file", "line"), "place").alias("at"))


def canonical_summary(spark, d):
    return canonical.model_counts(_scan(spark, d))


def native_usage(spark, d):
    return canonical.native_usage(_scan(spark, d))


QUERIES = {f.__name__: f for f in (canonical_relations, canonical_entities, canonical_evidence, canonical_summary, native_usage)}

_WITH = "WITH " + ",\n".join(f"{name} AS (SELECT {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM {t} WHERE {test})" for name, (t, test, columns) in SCAN.items())
# names in the form in which they are compared
_CLEAN = """,
sp AS (SELECT upper(trim(program)) AS p, path FROM sources),
tb AS (SELECT upper(trim(program)) AS p, upper(trim(name)) AS n, file, line FROM tables),
nf AS (SELECT upper(trim(program)) AS p, upper(trim(name)) AS n, coalesce(upper(kind), 'FILE') AS kind, keyed, access, file, line FROM native_files),
pr AS (SELECT upper(trim(program)) AS p, upper(name) AS n, kind, exported, file, line, 'PROCEDURE:' || upper(trim(program)) || ':' || upper(name) AS id FROM procedures),
pt AS (SELECT upper(trim(program)) AS p, upper(name) AS n, imported, upper(external) AS external, file, line, 'PROTOTYPE:' || upper(trim(program)) || ':' || upper(name) AS id FROM prototypes),
md AS (SELECT upper(trim(program)) AS p, upper(name) AS n, upper(file) AS f, file, line, coalesce(upper(kind), 'PROGRAM_MODULE') AS kind FROM modules),
bd AS (SELECT upper(trim(b.program)) AS p, 'MODULE:' || upper(trim(b.program)) || ':' || upper(b.file) || ':' || upper(b.module) AS id, b.kind, upper(b.name) AS n, b.file, m.line FROM bindings b
  JOIN (SELECT p, f, n, min(line) AS line FROM md GROUP BY 1, 2, 3) m ON m.p = upper(trim(b.program)) AND m.f = upper(b.file) AND m.n = upper(b.module)),
st AS (SELECT *, upper(trim(program)) AS p, upper(driver) AS d, 'SQL_STATEMENT:' || upper(trim(program)) || ':' || number AS id FROM statements),
pc AS (SELECT upper(trim(program)) AS p, owner_kind AS k, upper(owner) AS o, upper(name) AS n, dynamic, file, line FROM procedure_calls),
code(opcode, access, keyed, interactive, mutating) AS (VALUES ('CHAIN', 'READ', true, false, false), ('READ', 'READ', false, false, false), ('WRITE', 'WRITE', false, false, true), ('UPDATE', 'UPDATE', false, false, true), ('EXFMT', 'DISPLAY', false, true, false), ('SETLL', 'POSITION', true, false, false)),
ac0 AS (SELECT upper(trim(program)) AS p, owner_kind AS k, upper(owner) AS o, upper(opcode) AS op, upper(target) AS t, file, line FROM accesses),
first_ AS (SELECT * FROM nf QUALIFY row_number() OVER (PARTITION BY p, n ORDER BY line, kind, keyed) = 1),
sole AS (SELECT p, kind, min(n) AS n, CAST(max(CAST(keyed AS INT)) AS BOOLEAN) AS keyed FROM nf GROUP BY 1, 2 HAVING count(*) = 1),
ac AS (SELECT a.p, k, o, op, a.file, a.line, coalesce(f.n, w.n, q.n, v.n) AS n, coalesce(f.kind, w.kind, q.kind, v.kind) AS kind, CASE WHEN f.n IS NULL THEN t END AS record, c.access, c.keyed OR coalesce(f.keyed, w.keyed, q.keyed, v.keyed) AS keyed, c.interactive, c.mutating
  FROM ac0 a JOIN code c ON c.opcode = op LEFT JOIN first_ f ON f.p = a.p AND f.n = a.t
  LEFT JOIN sole w ON f.n IS NULL AND op = 'EXFMT' AND w.p = a.p AND w.kind = 'WORKSTN' LEFT JOIN sole q ON f.n IS NULL AND op = 'WRITE' AND q.p = a.p AND q.kind = 'PRINTER' LEFT JOIN sole v ON f.n IS NULL AND op = 'WRITE' AND v.p = a.p AND v.kind = 'WORKSTN'
  WHERE coalesce(f.n, w.n, q.n, v.n) IS NOT NULL),
us0 AS (SELECT p, n, kind, keyed, access, kind = 'WORKSTN' AS interactive, access IN ('WRITE', 'UPDATE') AS mutating, kind = 'WORKSTN' AS shown, NULL AS o, NULL AS record FROM nf
  UNION ALL SELECT p, n, kind, keyed, access, interactive, mutating, false, k || ':' || o, record FROM ac),
us AS (SELECT p AS program, n AS name, bool_or(keyed) AS keyed, bool_or(access = 'READ') AS read, bool_or(access = 'WRITE') AS write, bool_or(access = 'UPDATE') AS update, bool_or(access = 'DELETE') AS "delete", bool_or(access = 'POSITION') AS position,
  bool_or(access = 'DISPLAY' OR shown) AS display, bool_or(mutating) AS mutating, bool_or(interactive) AS interactive, count(DISTINCT o) AS n_owners, count(DISTINCT record) AS n_records,
  max({'rank': CASE kind WHEN 'FILE' THEN 0 WHEN 'DISK' THEN 1 ELSE 2 END, 'kind': kind}).kind AS kind FROM us0 GROUP BY 1, 2),
known AS (SELECT DISTINCT p, n, kind FROM pr),
rc AS (SELECT c.*, CASE WHEN dynamic THEN 'DYNAMIC' WHEN i.id IS NOT NULL THEN 'INTERNAL' WHEN e.id IS NOT NULL OR g.id IS NOT NULL THEN 'EXTERNAL' ELSE 'UNRESOLVED' END AS how, coalesce(i.id, e.id, g.id) AS found
  FROM pc c LEFT JOIN (SELECT DISTINCT p, n, id FROM pr) i ON i.p = c.p AND i.n = c.n LEFT JOIN (SELECT DISTINCT p, n, id FROM pt) e ON e.p = c.p AND e.n = c.n LEFT JOIN (SELECT n, min(id) AS id FROM pt GROUP BY 1) g ON g.n = c.n),
jn AS (SELECT upper(trim(program)) AS p, number, place, upper(name) AS n, coalesce(upper(type), 'INNER') AS type, condition FROM statement_joins)"""


def _own(k: str) -> str:
    return f"CASE WHEN {k} IS NOT NULL THEN 'PROCEDURE:' || x.p || ':' || x.o ELSE 'PROGRAM:' || x.p END"


_EDGES = f""",
edges(program, type, src, dst, site, attributes, file, line) AS (
SELECT p, 'HAS_SOURCE', 'PROGRAM:' || p, 'SOURCE_FILE:' || path, '', '', NULL, NULL FROM sp
UNION ALL SELECT p, 'USES_TABLE', 'PROGRAM:' || p, 'TABLE:' || n, '', '', file, line FROM tb
UNION ALL SELECT p, 'USES_NATIVE_FILE', 'PROGRAM:' || p, 'NATIVE_FILE:' || n, '', concat_ws(';', 'access=' || access, 'interactive=' || us.interactive, 'keyed=' || nf.keyed, 'kind=' || nf.kind, 'mutating=' || us.mutating), file, line FROM nf JOIN us ON us.program = p AND us.name = n
UNION ALL SELECT upper(trim(program)), 'CALLS_PROGRAM', 'PROGRAM:' || upper(trim(program)), 'PROGRAM:' || upper(name), '', 'kind=PROGRAM', file, line FROM calls
UNION ALL SELECT upper(trim(program)), 'INCLUDES_COPY', 'PROGRAM:' || upper(trim(program)), 'COPY_MEMBER:' || upper(name), '', '', file, line FROM copies WHERE trim(name) <> ''
UNION ALL SELECT p, 'OWNS_PROCEDURE', 'PROGRAM:' || p, id, '', 'kind=' || kind, file, line FROM pr
UNION ALL SELECT p, 'DECLARES_PROTOTYPE', 'PROGRAM:' || p, id, '', concat_ws(';', 'external=' || external, 'imported=' || imported), file, line FROM pt
UNION ALL SELECT p, 'HAS_MODULE', 'PROGRAM:' || p, 'MODULE:' || p || ':' || f || ':' || n, '', 'kind=' || kind || ';source=' || file, file, line FROM md
UNION ALL SELECT p, 'USES_BINDING_DIRECTORY', id, 'BINDING_DIRECTORY:' || n, '', '', file, line FROM bd WHERE kind = 'BINDING_DIRECTORY'
UNION ALL SELECT p, 'BINDS_SERVICE_PROGRAM', id, 'SERVICE_PROGRAM:' || n, '', '', file, line FROM bd WHERE kind = 'SERVICE_PROGRAM'
UNION ALL SELECT bd.p, 'IMPORTS_PROCEDURE', bd.id, coalesce(a.id, b.id, c.id), '', 'name=' || bd.n, bd.file, bd.line FROM bd LEFT JOIN (SELECT DISTINCT p, upper(file) AS f, n, id FROM pt) a ON a.p = bd.p AND a.f = upper(bd.file) AND a.n = bd.n
  LEFT JOIN (SELECT DISTINCT p, n, id FROM pt) b ON b.p = bd.p AND b.n = bd.n LEFT JOIN (SELECT n, min(id) AS id FROM pt GROUP BY 1) c ON c.n = bd.n WHERE kind = 'IMPORT' AND coalesce(a.id, b.id, c.id) IS NOT NULL
UNION ALL SELECT o.p, 'EXPORTS_PROCEDURE', 'SERVICE_PROGRAM:' || upper(e.name), o.id, '', concat_ws(';', 'level=' || coalesce(upper(level), 'CURRENT'), 'symbol=' || upper(symbol)), e.file, e.line FROM exports e JOIN (SELECT n, min_by(p, id) AS p, min(id) AS id FROM pr WHERE exported GROUP BY 1) o ON o.n = upper(symbol)
UNION ALL SELECT st.p, 'EXECUTES_SQL', 'PROGRAM:' || st.p, id, '', concat_ws(';', 'confidence=' || confidence, 'driver=' || d, 'dynamic=' || dynamic, 'intent=' || intent, 'joins=' || coalesce(c, 0), 'kind=' || upper(kind), 'reads=' || reads, 'unresolved=' || unresolved, 'writes=' || writes), file, line
  FROM st LEFT JOIN (SELECT p, number, count(*) AS c FROM jn GROUP BY 1, 2) j ON j.p = st.p AND j.number = st.number
UNION ALL SELECT st.p, 'SQL_REFERENCES_TABLE', id, 'TABLE:' || upper(t.name), '', '', file, line FROM st JOIN statement_tables t ON upper(trim(t.program)) = st.p AND t.number = st.number
UNION ALL SELECT p, 'DRIVES', id, 'TABLE:' || d, '', 'confidence=' || confidence, file, line FROM st WHERE d IS NOT NULL
UNION ALL SELECT st.p, 'JOINS_VIA', 'TABLE:' || d, 'TABLE:' || n, id || ':' || lpad(place::VARCHAR, 2, '0'), concat_ws(';', 'condition=' || condition, 'confidence=' || confidence, 'statement=' || id, 'type=' || type), file, line FROM st JOIN jn ON jn.p = st.p AND jn.number = st.number WHERE d IS NOT NULL
UNION ALL SELECT x.p, 'CALLS_PROCEDURE', {_own("k.p")}, CASE WHEN how IN ('INTERNAL', 'EXTERNAL') THEN found ELSE concat_ws(':', 'PROCEDURE_REF', x.p, o, x.n, line) END, line::VARCHAR, concat_ws(';', 'name=' || x.n, 'resolution=' || how), file, line FROM rc x LEFT JOIN known k ON k.p = x.p AND k.n = x.o AND k.kind = x.k
UNION ALL SELECT x.p, 'ACCESSES_NATIVE_FILE', {_own("k.p")}, 'NATIVE_FILE:' || x.n, line || ':' || op, concat_ws(';', 'access=' || access, 'interactive=' || interactive, 'keyed=' || keyed, 'kind=' || x.kind, 'mutating=' || mutating, 'opcode=' || op, 'record=' || record), file, line FROM ac x LEFT JOIN known k ON k.p = x.p AND k.n = x.o AND k.kind = x.k),
named AS (SELECT *, concat_ws('|', type, src, dst, nullif(site, '')) AS id FROM edges),
ends AS (SELECT program, dst AS id, file, line FROM edges UNION ALL SELECT program, src, NULL, NULL FROM edges)"""
_FIRST = "min(CASE WHEN file IS NOT NULL THEN {'file': file, 'line': line} END)"
_N = "count(DISTINCT CASE WHEN file IS NOT NULL THEN {'file': file, 'line': line} END)"
_WHOLE = _WITH + _CLEAN + _EDGES
_COUNTED = {
    "source_files": "SELECT p, path AS k FROM sp", "tables": "SELECT p, n FROM tb UNION SELECT upper(trim(program)), upper(name) FROM statement_tables", "program_calls": "SELECT upper(trim(program)), upper(name) FROM calls",
    "copy_members": "SELECT upper(trim(program)), upper(trim(name)) FROM copies", "sql_statements": "SELECT p, id FROM st", "read_statements": "SELECT p, id FROM st WHERE reads", "write_statements": "SELECT p, id FROM st WHERE writes",
    "dynamic_statements": "SELECT p, id FROM st WHERE dynamic", "unresolved_statements": "SELECT p, id FROM st WHERE unresolved", "procedures": "SELECT p, id FROM pr", "prototypes": "SELECT p, id FROM pt",
    "procedure_calls": "SELECT p, concat_ws(':', o, n, file, line) FROM rc", **{f"{h}_calls": f"SELECT p, concat_ws(':', o, n, file, line) FROM rc WHERE how = '{h.upper()}'" for h in ("internal", "external", "dynamic", "unresolved")},
    "native_files": "SELECT program, name FROM us", "mutating_files": "SELECT program, name FROM us WHERE mutating", "interactive_files": "SELECT program, name FROM us WHERE interactive", "record_formats": "SELECT program, name || ':' || unnest(range(n_records)) FROM us",
    "modules": "SELECT p, f || ':' || n FROM md", "service_programs": "SELECT upper(trim(program)), upper(name) FROM bindings WHERE kind = 'SERVICE_PROGRAM'", "binding_directories": "SELECT upper(trim(program)), upper(name) FROM bindings WHERE kind = 'BINDING_DIRECTORY'",
    "unresolved_bindings": "SELECT upper(trim(program)), file || ':' || module FROM bindings GROUP BY 1, 2 HAVING bool_and(kind = 'IMPORT')",
    **{c: f"SELECT upper(trim(program)), name FROM features WHERE kind = '{k}'" for c, k in (("built_ins", "BUILT_IN"), ("indicators", "INDICATOR"), ("data_structures", "STRUCTURE"), ("standalone_fields", "VARIABLE"))},
}
ORACLES = {
    "canonical_relations": f"{_WHOLE} SELECT program, id, type, src, dst, arg_min(attributes, {{'n': file IS NULL, 'file': file, 'line': line}}) AS attributes, {_N} AS n_evidence, {_FIRST}.file AS file, {_FIRST}.line::BIGINT AS line FROM named GROUP BY 1, 2, 3, 4, 5",
    "canonical_entities": f"{_WHOLE} SELECT program, id, split_part(id, ':', 1) AS type, substring(id, strpos(id, ':') + 1) AS name, {_N} AS n_evidence, {_FIRST}.file AS file, {_FIRST}.line::BIGINT AS line FROM ends GROUP BY 1, 2",
    "canonical_evidence": f"{_WHOLE} SELECT program, id, count(*) AS n, count(*) AS \"last\", max({{'file': file, 'line': line}}).file || ':' || max({{'file': file, 'line': line}}).line AS at FROM (SELECT program, id, file, line FROM named WHERE file IS NOT NULL UNION SELECT program, id, file, line FROM ends WHERE file IS NOT NULL) GROUP BY 1, 2",
    "canonical_summary": f"{_WITH}{_CLEAN}, marks(program, what, k) AS ({' UNION '.join(f'SELECT a, {chr(39)}{c}{chr(39)}, b::VARCHAR FROM ({q}) t(a, b)' for c, q in _COUNTED.items())}), n AS (SELECT program, {', '.join(f'count(*) FILTER (what = {chr(39)}{c}{chr(39)}) AS {c}' for c in canonical.COUNTS)} FROM marks GROUP BY 1)\nSELECT *, program || ' uses ' || tables || ' tables, calls ' || program_calls || ' programs, includes ' || copy_members || ' copy members, owns ' || procedures || ' procedures and executes ' || sql_statements || ' statements.' AS text FROM n",
    "native_usage": f"{_WITH}{_CLEAN} SELECT program, name, kind, keyed, read, write, update, \"delete\", position, display, mutating, interactive, n_owners, n_records FROM us",
}

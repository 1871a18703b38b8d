"""Guarded SQL: read-only checks, identifiers, batches, change-safety rules and paging tokens (driver side)."""

from __future__ import annotations

import base64
import json
import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_ROWS, MAX_ROWS = 50, 200
DEFAULT_LIMIT, MAX_LIMIT = 20, 200
IDENTIFIER = re.compile(r"[A-Z][A-Z0-9_#$@]*\Z")
#: Logical plans that only read; commands are refused by what they parse to, without running them.
_WRITES = ("Insert", "Delete", "Update", "Merge", "Create", "Drop", "Alter", "Truncate", "Replace", "Command", "SetNamespace", "Load", "Repair", "Cache", "Uncache", "Refresh", "AddPartitions", "Rename")
#: Functions that run code of the driver's or executors' classes.
_RUNS_CODE = ("reflect", "try_reflect", "java_method")


def without_comments(sql: str) -> str:
    """Block and line comments out, except within quotes."""
    return re.sub(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")|/\*.*?\*/|--[^\r\n]*", lambda m: m[1] or " ", sql, flags=re.S)


def split_statements(sql: str) -> list[str]:
    """Statements between semicolons that stand outside quotes."""
    parts, start = [], 0
    text = without_comments(sql)
    for m in re.finditer(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|;", text):
        if m[0] == ";":
            parts.append(text[start : m.start()])
            start = m.end()
    return [p.strip() for p in (*parts, text[start:]) if p.strip()]


def check_read_only(spark: SparkSession, sql: str) -> str:
    """The statement, if it starts with SELECT or WITH and parses to a plan that reads only; ValueError otherwise."""
    text = without_comments(sql).strip().rstrip(";").strip()
    if not text:
        raise ValueError("the query is empty")
    if not re.match(r"(SELECT|WITH)\b", text, re.I):
        raise ValueError("a query must start with SELECT or WITH")
    left = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind.startswith(_WRITES):
            raise ValueError("the query does more than read")
        names = [x.lower() for x in _seq(node.nameParts())] if kind == "UnresolvedFunction" else [x.lower() for x in _seq(node.name())] if kind == "UnresolvedTableValuedFunction" else []
        if names and names[-1] in _RUNS_CODE:
            raise ValueError(f"{names[-1]} runs code")
        if kind == "UnresolvedRelation" and any("/" in x or ":" in x for x in _seq(node.multipartIdentifier())):
            raise ValueError("a query reads tables, not paths")
        left += _seq(node.children())
        if hasattr(node, "expressions") and _is_plan(spark, node):
            left += [*_seq(node.expressions()), *(x for x in _seq(node.innerChildren()) if _is_node(spark, x))]
            if kind == "UnresolvedWith":
                left += [pair._2() for pair in _seq(node.cteRelations())]
        elif _is_subquery(spark, node):
            left.append(node.plan())
    return text


def _seq(found) -> list:
    return [found.apply(k) for k in range(found.size())]


def _is(spark: SparkSession, node, name: str) -> bool:
    from py4j.java_gateway import is_instance_of

    return is_instance_of(spark.sparkContext._gateway, node, f"org.apache.spark.sql.catalyst.{name}")


def _is_node(spark, node) -> bool:
    return _is(spark, node, "trees.TreeNode")


def _is_plan(spark, node) -> bool:
    return _is(spark, node, "plans.logical.LogicalPlan")


def _is_subquery(spark, node) -> bool:
    return _is(spark, node, "expressions.SubqueryExpression")


def read_only(spark: SparkSession, sql: str, max_rows: int | None = DEFAULT_ROWS, args: dict | None = None) -> DataFrame:
    """Rows of one guarded statement; named parameters instead of spliced literals."""
    df = spark.sql(check_read_only(spark, sql), args=args or {})
    return df if max_rows is None else df.limit(max_rows)


def read_only_batch(spark: SparkSession, sql: str, max_rows: int | None = DEFAULT_ROWS) -> list[DataFrame]:
    """Every statement is checked before the first runs."""
    checked = [check_read_only(spark, s) for s in split_statements(sql)]
    return [spark.sql(s) if max_rows is None else spark.sql(s).limit(max_rows) for s in checked]


def identifier(name: str) -> str:
    upper = name.strip().upper()
    if not IDENTIFIER.match(upper):
        raise ValueError(f"not an identifier: {name!r}")
    return upper


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_PREDICATE = re.compile(r"""'(?:[^']|'')*'|"[^"]*"|[A-Za-z_#$@][\w.#$@]*|\d+(?:\.\d+)?|[<>!]=|<>|\S""")
#: Words that a condition without columns may hold.
_CONSTANT_WORDS = {"TRUE", "FALSE", "NULL", "NOT", "AND", "OR", "IS", "IN", "LIKE", "BETWEEN"}


def _unwrapped(parts: list[str]) -> list[str]:
    """Tokens without brackets around all of them."""
    while len(parts) > 1 and parts[0] == "(" and parts[-1] == ")":
        depth = 0
        for k, t in enumerate(parts):
            depth += (t == "(") - (t == ")")
            if depth == 0 and k < len(parts) - 1:
                return parts
        parts = parts[1:-1]
    return parts


def _alternatives(parts: list[str]) -> list[list[str]]:
    """The comparisons that stand next to an OR, at any depth, without brackets."""
    out, joins = [[]], [""]
    for t in parts:
        if t.upper() in ("OR", "AND"):
            joins.append(t.upper())
            out.append([])
        elif t not in "()":
            out[-1].append(t)
    return [a for a, before, after in zip(out, joins, [*joins[1:], ""], strict=True) if "OR" in (before, after)]


def _holds_always(parts: list[str]) -> bool:
    """Whether a condition names no column and Spark, which folds its constants, finds it true."""
    if not parts or any(t[0].isalpha() and t.upper() not in _CONSTANT_WORDS or t[0] in "\"_#$@`;" for t in parts):
        return False
    spark = SparkSession.active()
    try:
        return bool(spark.range(1).select(F.expr(" ".join(parts)).cast("boolean")).first()[0])
    except (ParseException, AnalysisException):
        return False


def weak_predicate(where: str | None) -> str | None:
    """Why a WHERE clause restricts too little, or None."""
    parts = _unwrapped(_PREDICATE.findall((where or "").strip().rstrip(";")))
    if not parts or _holds_always(parts):
        return "ALWAYS_TRUE"
    if any(_holds_always(a) for a in _alternatives(parts)):
        return "OR_TAUTOLOGY"
    name, *rest = parts
    if name[0] not in "'(" and [t.upper() for t in rest] == ["IS", "NOT", "NULL"]:
        return "ONLY_NOT_NULL"
    if len(rest) == 2 and rest[0].upper() == "LIKE" and rest[1].startswith("'") and not rest[1].strip("'%") and "%" in rest[1]:
        return "LIKE_ANYTHING"
    return None


def change_target(sql: str) -> str | None:
    m = re.match(r'\s*(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO)\s+([\w.$#@/"]+)', without_comments(sql), re.I)
    return m[1].replace('"', "").replace("/", ".").upper() if m else None


def change_allowed(sql: str, allowed: list[str]) -> bool:
    """Whether a change's table is listed; an entry without a schema covers every schema."""
    target = change_target(sql)
    return target is not None and any(target == a.upper() or ("." not in a and target.rpartition(".")[2] == a.upper()) for a in allowed)


def simulated_change(spark: SparkSession, table: str, where: str, max_rows: int = 100) -> dict:
    """What a guarded UPDATE or DELETE would touch: counted, never run."""
    reason = weak_predicate(where)
    rows = None if reason else spark.table(table).filter(where).count()
    return {"allowed": reason is None and rows <= max_rows, "rows": rows, "reason": reason or ("TOO_MANY_ROWS" if rows > max_rows else None)}


def page_token(tool: str, offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "t": tool, "o": offset}).encode()).decode().rstrip("=")


def page_offset(token: str, tool: str) -> int:
    try:
        found = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    except ValueError as bad:
        raise ValueError("not a page token") from bad
    if found.get("v") != 1 or found.get("t") != tool or not isinstance(found.get("o"), int) or found["o"] < 0:
        raise ValueError("the page token is of another tool or version")
    return found["o"]


def page(df: DataFrame, order: list[str], tool: str, token: str | None = None, limit: int = 20) -> tuple[DataFrame, str]:
    """One page by a total order, and the token of the next."""
    offset = page_offset(token, tool) if token else 0
    return df.orderBy(*order).offset(offset).limit(limit), page_token(tool, offset + limit)


def counted_page(df: DataFrame, order: list[Column | str], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """One page by a total order, with total (rows of df) and omitted (whether rows follow it). Bad limits and offsets fail."""
    size, start = DEFAULT_LIMIT if limit is None else limit, 0 if offset is None else offset
    if not isinstance(size, int) or not 1 <= size <= MAX_LIMIT or not isinstance(start, int) or start < 0:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}, offset not negative")
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(start).limit(size).crossJoin(total).withColumn("omitted", F.col("total") > start + size)  # one row


def key_select(schema: str, table: str, keys: dict[str, object], columns: list[str] | None = None) -> str:
    """A SELECT of rows by key equality; identifiers are checked, values quoted unless they are numbers."""
    if not keys:
        raise ValueError("a key is needed")
    shown = ", ".join(map(identifier, columns)) if columns else "*"
    tests = [f"{identifier(c)} = {v}" if isinstance(v, (int, float)) and not isinstance(v, bool) else f"{identifier(c)} = {quoted(str(v))}" for c, v in keys.items()]
    return f"SELECT {shown} FROM {identifier(schema)}.{identifier(table)} WHERE {' AND '.join(tests)}"

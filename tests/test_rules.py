"""Weak predicates, filters, states and patterns: decided from tokens."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import candidates, sqltext
from tracewell.plans import guard


@pytest.mark.parametrize("where,why", [
    (None, "ALWAYS_TRUE"), (" ; ", "ALWAYS_TRUE"), ("1=1", "ALWAYS_TRUE"), ("((1 <> 0))", "ALWAYS_TRUE"), ("'a' = 'a'", "ALWAYS_TRUE"), ("2 > 1 AND TRUE", "ALWAYS_TRUE"), ("1 BETWEEN 0 AND 2", "ALWAYS_TRUE"),
    ("1 = 0", None), ("A = 1", None), ("A = 2 OR 1=1", "OR_TAUTOLOGY"), ("(A = 2 or (true)) and B = 3", "OR_TAUTOLOGY"), ("1=1 AND A = 2", None), ("A = 'OR 1=1'", None), ("A = 1 OR B = 1", None), ("A = 1 OR 1 = 2", None),
    ("(A.B IS NOT NULL)", "ONLY_NOT_NULL"), ('"x y" is not null', "ONLY_NOT_NULL"), ("A IS NULL", None), ("A LIKE '%%'", "LIKE_ANYTHING"), ("A LIKE '%a%'", None), ("A LIKE ''", None), ("1 = ", None), ("reflect('x')", None),
])
def test_weak_predicates(spark, where, why):
    assert guard.weak_predicate(where) == why


def test_filters(spark):
    rows = [("A = 1 AND B = 'x AND y'", ["A = 1", "B = 'x AND y'"], False), ("A = 1 and  B > 2", ["A = 1", "B > 2"], False), ("A = 1 OR B = 2", ["A = 1 OR B = 2"], True), ("F(A) = 1", ["F(A) = 1"], True), ("A = 'LIKE'", ["A = 'LIKE'"], False), ("", [], False)]
    df = spark.createDataFrame([(k, c) for k, (c, _, _) in enumerate(rows)], "id int, c string")
    got = {r["id"]: (r["f"], r["h"]) for r in df.select("id", sqltext.where_filters(F.col("c"))[0].alias("f"), sqltext.where_filters(F.col("c"))[1].alias("h")).collect()}
    assert got == {k: (f, h) for k, (_, f, h) in enumerate(rows)}


def test_states(spark):
    code = next(iter(candidates.ERROR_STATES))
    rows = [("fails, SQLSTATE=42704 here", "42704"), ("SQLSTATE : 42a04", "42A04"), ("sqlstate42501", "42501"), ("SQLSTATE (42501)", ""), (f"{code.lower()} then SQLSTATE 00000", candidates.ERROR_STATES[code]), ("SQL9876", "SQL9876"), ("XSQL9876 SQL98765", ""), ("SQLSTATE 1234 SQL0001x", ""), (None, "")]
    got = spark.createDataFrame([(k, m) for k, (m, _) in enumerate(rows)], "id int, m string").select("id", candidates.error_state(F.col("m")).alias("s")).collect()
    assert {r["id"]: r["s"] for r in got} == {k: s for k, (_, s) in enumerate(rows)}


def test_patterns(spark):
    find = lambda p, t: spark.range(1).select(F.lit(t).rlike(p)).first()[0]
    assert find(candidates.search_pattern(member="Stock7"), "call STOCK7;") and not find(candidates.search_pattern(member="Stock7"), "STOCK71") and not find(candidates.search_pattern(member="stock7", case=True), "stock7")
    assert find(candidates.search_pattern(table="items"), "delete  from items") and not find(candidates.search_pattern(table="items"), "items from")

"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tracewell.plans import catalogue
from tracewell.session import TABLES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_agrees_with_sql(spark, database, name):
    df = catalogue.queries()[name](spark, str(DATA))
    got = rows_of(df.columns, df.collect())
    cursor = database.execute(catalogue.oracle_sql()[name])
    wanted = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in cursor.description)
    assert len(got) == len(wanted)
    for g, w in zip(got, wanted, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or float(a) == pytest.approx(float(b), abs=1e-6)

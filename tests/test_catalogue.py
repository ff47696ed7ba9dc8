"""Every registered query with SQL gives the SQL's rows; every query gives a stable schema."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("QUERN_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

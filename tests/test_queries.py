"""Every query of the core library that SQL can say against its SQL, on the smallest tables; for the others see test_brute."""

import os

import duckdb
import pytest

from vellum.plans.catalog import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
ALL, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.execute(f"create view {t.split('.')[0]} as select * from '{DIR}/{t}'")
    return c


def plain(x):
    if x is None or x != x:
        return None
    return round(float(x), 4) if isinstance(x, float) or type(x).__name__ in ("Decimal", "float64") else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = ALL[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    a, b = rows(df.columns, got), rows(columns, want.fetchall())
    norm = lambda rs: [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in rs]
    assert norm(a) == norm(b)

"""Every registered query against its SQL, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from noemata.plans.catalogue import QUERIES
from noemata.plans.oracle import SQL

from .conftest import SMALL


def plain(x):
    if x is None or isinstance(x, float) and x != x:
        return None
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 5) + 0.0
    return str(x)[:19] if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    found = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    told = duck.execute(SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in told.fetchall()), key=repr)
    assert found == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0

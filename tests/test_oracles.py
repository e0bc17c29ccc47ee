"""Every registered query with SQL gives the rows that DuckDB gives, over the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from spanloom import catalog

CASES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", CASES)
def test_oracle(spark, con, sf, name):
    df = catalog.queries()[name](spark, sf)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    ran = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[i]) for i in order) for r in ran.fetchall()), key=str)
    assert got == want

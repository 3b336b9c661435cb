"""Every query of the reference operators against its SQL, run by DuckDB over the same files."""

import math
import os

import duckdb
import pytest

from sparkloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    """Floats to nine digits; lists and rows as tuples."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return x


def rows(found):
    return sorted(repr(tuple(map(cell, r))) for r in found)


@pytest.fixture(scope="module")
def duck():
    data = os.environ.get("SPARKLOOM_TEST_DATA", "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con, data


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    con, data = duck
    df = registry.QUERIES[name](spark, data)
    found = con.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(found.fetchall())
    assert rows(df.select(*names).collect()) == want
    assert want, "a query that finds nothing shows nothing"


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, duck, name):
    df = registry.QUERIES[name](spark, duck[1])
    assert all(len(r) == len(df.columns) for r in df.collect())

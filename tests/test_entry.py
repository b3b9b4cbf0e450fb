"""The registered queries of the engine against their SQL, and the flagship query."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from codemill.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.01"


def key(value):
    if isinstance(value, float):
        return round(value, 5)
    return tuple(map(key, value)) if isinstance(value, list) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    wanted = duck.execute(SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert Counter(tuple(key(r[c]) for c in columns) for r in found.collect()) == Counter(tuple(map(key, r)) for r in wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").collect() is not None


def test_flagship_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())

"""Registered queries against the same queries in SQL, on the smallest tables: all of them."""

import datetime
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from scanweave.plans import oracle, registered

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
ALL = sorted(registered.QUERIES)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def plain(value):
    return value.isoformat() if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", ALL)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert got


def test_every_query_has_sql():
    assert set(registered.QUERIES) == set(oracle.oracle())
    assert set(entry.oracle_sql()) <= set(entry.queries())

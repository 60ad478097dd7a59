"""Every core query against its SQL on the smallest tables; those without SQL must run."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tapeloom.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{data}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    if name in SQL:
        cursor = duck.execute(SQL[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())
    else:
        assert got and len(set(df.columns)) == len(df.columns)


def test_entry_runs(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())

"""The pN_ queries on the smallest tables: they run, and those with SQL agree with it."""

from __future__ import annotations

import os

import duckdb
import pytest

from tapeloom.llm import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
COLUMNS = {"p1_found": ["doc_id", "lang_code"], "p2_found": ["table_name", "first_id", "copy_id"], "p3_found": ["row_id", "field_name"], "p6_found": ["doc_id", "item_id"], "p7_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    assert rows and df.columns == COLUMNS.get(name, df.columns)
    if name in COLUMNS:
        assert len(set(rows)) == len(rows)
    if name in SQL:
        con = duckdb.connect()
        for file in os.listdir(data):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{data}/{file}'")
        cursor = con.execute(SQL[name])
        assert [d[0] for d in cursor.description] == df.columns and sorted(cursor.fetchall()) == sorted(rows)

"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import TABLES

SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return connection


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return f"{v:.6f}" if math.isfinite(v) else str(v)
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, duck, name):
    found = queries()[name](spark, sf)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(names)
    assert canonical([tuple(r) for r in found.collect()], found.columns) == canonical(cursor.fetchall(), names)


def test_entry(spark):
    assert entry(spark).count() > 0

"""Every query that SQL can express, against DuckDB on the same files."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from catalog import oracle, queries

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
ORACLE = oracle.oracle_sql()
QUERIES = queries.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def _sorted(table):
    clean = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row) for row in table]
    return sorted(clean, key=lambda row: [(v is None, str(type(v)), v) for v in row])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    want = [tuple(row[i] for i in place) for row in found.fetchall()]
    mine = [tuple(row) for row in df.select(*columns).collect()]
    assert len(mine) == len(want)
    assert _sorted(mine) == _sorted(want)


def test_registration(spark):
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())
    flagship = entry.entry(spark)
    assert flagship.columns[:2] == ["machine_id", "machine_name"] and flagship.count() > 0

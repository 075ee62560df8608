"""Every query of the folder that SQL can express, against DuckDB on the same files, and the contract of the others."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict

import duckdb
import pytest

from millwright.llm import queries

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ORACLE = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = queries.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in found.fetchall()), key=str)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == want


def test_packing_query_keeps_its_contract(spark):
    docs = {r.doc_id: r.text for r in queries.table(spark, FOLDER, "documents").collect()}
    rows = queries.op2_best_fit_packing(spark, FOLDER).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for found in pieces.values():
        at = 0
        for n, (piece, start, length) in enumerate(sorted(found)):
            assert (piece, start) == (n, at) and (length == 4096 or n == len(found) - 1)
            at += length
    for found in places.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:i]) for i in range(len(found))]
        assert sum(n for _, n in found) <= 4096
    tokens = sum(n for found in places.values() for _, n in found)
    assert len(places) <= -(-tokens // 4096) + 2


def test_quality_query_keeps_its_contract(spark):
    labels = {r.doc_id: r.quality for r in queries.table(spark, FOLDER, "labels").collect()}
    rows = queries.op4_compression_quality(spark, FOLDER).collect()
    assert len(rows) == queries.table(spark, FOLDER, "documents").count()
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out and r.doc_id in labels:
            right.append(r.predicted == labels[r.doc_id])
    assert sum(right) >= 0.9 * len(right)

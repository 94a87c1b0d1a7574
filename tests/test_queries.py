"""Every registered core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import verify
from tremolo import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in verify.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, tables, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(verify.norm(r[c]) for c in cols) for r in df.collect())
    if name in queries.SQL:
        rel = tables.sql(queries.SQL[name])
        at = [rel.columns.index(c) for c in cols]
        assert len(rel.columns) == len(cols)
        assert rows == sorted(tuple(verify.norm(r[i]) for i in at) for r in rel.fetchall())

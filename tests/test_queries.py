"""Each registered query against DuckDB."""

import glob
import os

import duckdb
import pytest

from weft.workload import operators, social, surface

DIR = "/root/testdata/sf0.01"
QUERIES, SQL = operators.QUERIES | social.QUERIES | surface.QUERIES, operators.SQL | social.SQL | surface.SQL


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DIR)
    relation = db.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    order = [relation.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in order) for r in relation.fetchall())

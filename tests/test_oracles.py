"""Every registered query against its SQL on DuckDB, at the smallest scale."""
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import cell

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, sf, key):
    df = QUERIES[key](spark, sf)
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(SQL[key])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    norm = lambda rows, cols: sorted((tuple(cell(r[cols.index(c)]) for c in sorted(cols)) for r in rows), key=repr)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), names)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, key):
    assert QUERIES[key](spark, sf).columns


def test_entry(spark):
    assert entry.entry(spark).count() == 3

"""Every registered query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

LLM = {f"op{n}_" for n in range(1, 14)}
SQL = {k: v for k, v in entry.oracle_sql().items() if k.split("_")[0] + "_" not in LLM and k != "pipeline"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert canonical(got.columns, got.collect()) == canonical(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1

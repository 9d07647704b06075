"""Every catalogue query with a SQL twin equals DuckDB on sf0.001 (row count,
column names, order-insensitive value hash with doubles rounded to 6 dp)."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as E
from moodspark.sources.tables import TABLES

_spec = importlib.util.spec_from_file_location(
    "check_oracle", os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools", "check_oracle.py"))
_check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_check)

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, sf_small, name):
    sdf = E.queries()[name](spark, sf_small)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    hs, _ = _check._digest(sdf.columns, srows)
    hd, _ = _check._digest(dcols, drows)
    assert hs == hd


def test_every_query_registered_has_callable():
    q = E.queries()
    assert set(SQL) <= set(q)
    assert len(q) >= 60


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["word", "n", "rel_freq"]
    assert df.count() > 0

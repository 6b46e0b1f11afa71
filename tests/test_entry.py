"""Driver contract and the DuckDB oracle of every registered query (at sf0.001)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from kiln.plans.registry import REGISTRY
from kiln.sources.tables import TABLES

from .conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "advantage" in df.columns


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, con, name):
    df = REGISTRY[name].fn(spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    sql = REGISTRY[name].sql
    if sql is None:
        assert rows
        return
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order_s = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    order_d = sorted(range(len(cols)), key=lambda i: cols[i])
    s = sorted(repr([_norm(r[i]) for i in order_s]) for r in rows)
    d = sorted(repr([_norm(r[i]) for i in order_d]) for r in cur.fetchall())
    assert s == d

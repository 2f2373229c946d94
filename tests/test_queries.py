"""Every query against its SQL in DuckDB, and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__
from turnloom.plans.queries import ORACLE, QUERIES

TABLES = "events documents embeddings labels conversations".split()


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return float(v) if hasattr(v, "__float__") and not isinstance(v, (bool, str)) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    if name not in ORACLE:
        assert got
        return
    r = duck.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    assert got == want


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0

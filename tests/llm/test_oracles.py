"""The llm queries that have SQL, against DuckDB."""

import duckdb
import pytest

from turnloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    r = c.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(row[names.index(x)] for x in cols) for row in r.fetchall()), key=repr)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == want

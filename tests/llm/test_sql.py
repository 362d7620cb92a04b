"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from rallylake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_what_its_sql_gives(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    found = sorted(tuple(r) for r in df.select(names).collect())
    assert found and found == sorted(cursor.fetchall())

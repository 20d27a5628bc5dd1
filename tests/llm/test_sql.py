"""Queries that have SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from textwerk.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, data, name):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = queries.QUERIES[name](spark, data)
    result = con.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(result.fetchall())

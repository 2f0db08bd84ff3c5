"""Queries with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from check import rows_of
from codelake.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracle(spark, sf_dir, key):
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = con.sql(ORACLES[key])
    frame = QUERIES[key](spark, sf_dir)
    assert sorted(frame.columns) == sorted(result.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(result.columns, result.fetchall())

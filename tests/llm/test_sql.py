"""Queries of corpus operators that SQL can express give DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tamarisk.llm import queries
from tests.test_queries import SF_DIR, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    link = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        link.execute(f"create view {path.stem} as select * from '{path}'")
    assert rows(queries.QUERIES[name](spark, SF_DIR).toPandas()) == rows(link.sql(queries.ORACLE_SQL[name]).df())

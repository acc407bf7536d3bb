"""Every registered query that SQL can express gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tamarisk.plans import registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 9)
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    return plain(x.item()) if hasattr(x, "item") else x


def rows(frame: pd.DataFrame):
    names = sorted(frame.columns)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    link = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        link.execute(f"create view {path.stem} as select * from '{path}'")
    return link


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF_DIR).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF_DIR).count() > 0

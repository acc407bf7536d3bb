"""All registered queries and the DuckDB text of each."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tamarisk.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, extra: str = ""):
    """Registers a function of ``Views``; ``oracle`` may name any view, ``extra`` adds common table expressions."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = with_views(oracle, extra)
        return f

    return register


for _module in ("analytics_queries", "cleaning_queries", "gold_queries", "serving_queries", "layer_queries"):
    import_module(f"tamarisk.plans.{_module}")

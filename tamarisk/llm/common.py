"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.sources.shared import checkpoint_dir, cut  # noqa: F401

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers that a broadcast may hold; larger sides are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def join_smaller(large: DataFrame, small: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join a checkpointed narrow table: broadcast it if its count is small, else let both sides shuffle."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return large.join(small, on, how)


#: Rows in one Arrow batch of whole texts; a worker holds one batch at a time.
BATCH_ROWS = 1_000


def map_batches(rows: DataFrame, f: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInPandas`` over small batches, for rows that hold whole texts.

    Spark reads the size of batches from the session alone, when it plans the query; so the
    session's size is lowered to ``BATCH_ROWS`` if it is larger, and stays so.
    """
    _small_batches(rows.sparkSession)
    return rows.mapInPandas(tidy(f), schema)


def map_arrow(rows: DataFrame, f: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInArrow`` over the same small batches: ids keep their type where they are null."""
    _small_batches(rows.sparkSession)
    return rows.mapInArrow(tidy(f), schema)


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0") or 0) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives its memory back when its task ends."""

    @wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run

"""Tables of the session's catalog: load, upsert by key, publish. Every row goes from its task to the table's files."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import scd
from tamarisk.sources.shared import cut
from tamarisk.sources.tables import MODES

#: Partition column of tables that take upserts: a part of the keys' hash.
PART = "_key_part"


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def load(df: DataFrame, table: str, if_exists: str = "append", key: str | None = None, parts: int = 64, path: str | None = None) -> int:
    """Writes the rows and returns their number, counted as they are written; without rows nothing is written.

    ``key`` cuts a new table into ``parts`` by key, as ``upsert`` needs it. ``path`` is where a new table is kept
    (default: the warehouse).
    """
    if df.isEmpty():
        return 0
    seen = Observation()
    rows = df if key is None else df.withColumn(PART, _part(key, parts))
    writer = rows.observe(seen, F.count("*").alias("n")).write.mode(MODES[if_exists]).format("parquet")
    writer = writer if key is None else writer.partitionBy(PART)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return seen.get["n"]


def read(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).drop(PART)


@contextmanager
def _touched_only(spark: SparkSession) -> Iterator[None]:
    """Inside, an overwrite replaces only the partitions that it has rows for."""
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name, "static")
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def upsert(df: DataFrame, table: str, key: str, order: str | None = None, parts: int = 64) -> int:
    """Rows of known keys replace the old ones, others are added; no other row is touched.

    Only the parts of the table that hold one of the keys are read and written again; they are replaced when all are
    written. Of rows with the same key the last by ``order`` counts. ``parts`` is that of the load. Returns the
    number of rows that were put in.
    """
    spark = df.sparkSession
    rows = cut(scd.latest_by_key(df, key, order).withColumn(PART, _part(key, parts)))
    touched = [r[PART] for r in rows.select(PART).distinct().collect()]  # a number for each part at most
    if not touched:
        return 0
    old = spark.table(table)
    held = old.where(F.col(PART).isin(touched))
    merged = cut(scd.upsert(held, rows, key, order))  # read in full before what it comes from is replaced
    with _touched_only(spark):
        merged.select(*old.columns).repartition(PART).write.mode("overwrite").insertInto(table)
    return rows.count()


def publish(tables: Mapping[str, DataFrame], paths: Mapping[str, str] | None = None) -> dict[str, int]:
    """Report tables to the warehouse in replace mode, without the layer column."""
    return {name: load(df.drop("_layer"), name, "replace", path=(paths or {}).get(name)) for name, df in tables.items()}

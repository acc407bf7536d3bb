"""Queries of a data service: filter, page, project, describe."""

from __future__ import annotations

import logging
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.sources import files, loads

log = logging.getLogger(__name__)

INTERNAL = ("_layer", "_source_file", "_ingested_at")
PERSONAL = ("respondent_name", "household_head_name", "enumerator_name", "gps_latitude", "gps_longitude", "gps_accuracy_m")
#: Type names of business-intelligence tools.
TOOL_TYPES = {"int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "boolean": "bool", "date": "datetime", "timestamp": "datetime", "timestamp_ntz": "datetime"}


def equal_to(df: DataFrame, filters: Mapping[str, str], exact: bool = False) -> DataFrame:
    """Rows that have the given values, letter case aside; names that aren't columns are ignored.

    ``exact`` compares the stored value, which the file reader can use to skip row groups.
    """
    for name, value in filters.items():
        if name in df.columns:
            df = df.where(F.col(name) == F.lit(value)) if exact else df.where(F.lower(F.col(name).cast("string")) == str(value).lower())
    return df


def page(df: DataFrame, order: Sequence[str], offset: int = 0, limit: int = 10_000, most: int = 50_000) -> DataFrame:
    """One page in a total order, with the number of rows before paging as ``total``."""
    total = df.agg(F.count("*").alias("total"))
    rest = [c for c in df.columns if c not in order]
    return df.orderBy(*order, *rest).offset(offset).limit(min(limit, most)).crossJoin(F.broadcast(total))  # one row


def fields(df: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """The named columns that exist; all if none does."""
    have = [c for c in names or [] if c in df.columns]
    return df.select(*have) if have else df


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text to the second, without internal columns."""
    times = [c for c, kind in df.dtypes if kind.startswith("timestamp")]
    return df.drop(*INTERNAL).withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in times if c not in INTERNAL})


def without_personal(df: DataFrame) -> DataFrame:
    return df.drop(*PERSONAL)


def tool_schema(df: DataFrame) -> DataFrame:
    """``id, alias, type`` of each column."""
    rows = [(f.name, f.name.replace("_", " ").title(), TOOL_TYPES.get(f.dataType.simpleString().split("(")[0], "float" if f.dataType.typeName().startswith("decimal") else "string")) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "id string, alias string, type string")


@contextmanager
def footer_counts(spark: SparkSession) -> Iterator[None]:
    """Inside, counts of Parquet tables are answered from the files' footers."""
    changes = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text"}
    before = {k: spark.conf.get(k, None) for k in changes}
    try:
        for k, x in changes.items():
            spark.conf.set(k, x)
        yield
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def as_read(spark: SparkSession, path: str, suffix: str) -> DataFrame | None:
    """The dataset as its readers see it: the newest version, the committed loads, or the files."""
    if done := files.versions(spark, path):
        return spark.read.parquet(files.version_path(path, done[-1]))
    if loads.committed(spark, path):
        return loads.read(spark, path)
    return files.read(spark, path, suffix or "parquet") if suffix in ("", *files.FORMATS) else None


def layer_statistics(spark: SparkSession, roots: Mapping[str, str]) -> DataFrame:
    """``layer, dataset, files, kb, rows, columns`` of all layers from one listing of each.

    Rows of Parquet tables come from their footers, those of other formats from one pass over their files. A
    dataset that can't be read has NULL rows and columns.
    """
    out = None
    for layer, root in roots.items():
        found = files.with_names(files.listing(spark, root)).where("suffix != 'crc'").withColumn("layer", F.lit(layer))
        out = found if out is None else out.unionByName(found)
    sizes = out.groupBy("layer", F.col("stem").alias("dataset"), "dataset_path", "suffix").agg(F.count("*").alias("files"), F.round(F.sum("length") / 1024, 1).alias("kb"))
    rows = []
    with footer_counts(spark):
        for r in sizes.collect():  # a row for each dataset
            n = columns = None
            try:
                if (df := as_read(spark, r["dataset_path"], r["suffix"])) is not None:
                    n, columns = df.agg(F.count("*")).first()[0], len(df.columns)
            except Exception as error:  # one bad dataset doesn't hide the others
                log.warning("dataset %s can't be read: %s", r["dataset_path"], error)
            rows.append((r["layer"], r["dataset"], r["files"], r["kb"], n, columns))
    return spark.createDataFrame(rows, "layer string, dataset string, files long, kb double, rows long, columns int")


def recent_runs(history: DataFrame, n: int = 20) -> DataFrame:
    return history.orderBy(F.desc("ts"), F.desc("run_id")).limit(n)

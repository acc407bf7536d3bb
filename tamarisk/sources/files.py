"""Readers and writers by file format, object-store or local path alike (Spark resolves the URI)."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)
#: Suffix to format, best first.
FORMATS = {"parquet": "parquet", "json": "json", "jsonl": "json", "csv": "csv", "avro": "avro"}
PRIORITY = {"parquet": 1, "json": 2, "jsonl": 2, "csv": 3, "avro": 4}


def format_of(path: str) -> str:
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported format: {path}")
    return FORMATS[suffix]


def has_avro(spark: SparkSession) -> bool:
    """Whether the session has the Avro data source."""
    session = spark._jsparkSession
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource("avro", session.sessionState().conf())
    except Exception:  # the Java side says why
        return False
    return True


def read(spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None) -> DataFrame | None:
    """One dataset. CSV comes as strings with a header; Avro without its data source is skipped (None)."""
    kind = FORMATS[fmt] if fmt else format_of(path)
    if kind == "avro" and not has_avro(spark):
        log.warning("no Avro data source, skipped: %s", path)
        return None
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def listing(spark: SparkSession, *roots: str, pattern: str = "*") -> DataFrame:
    """``path, length, modified`` of the files under the roots; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.load(list(roots)).select("path", "length", F.col("modificationTime").alias("modified"))


def with_names(files: DataFrame) -> DataFrame:
    """Adds ``stem`` and ``suffix`` of the dataset: that of the file, or of the folder that Spark wrote it to."""
    inner = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", r"(/[^/=]+=[^/]*)*/[^/]*$", "")  # without the folders of partitions, versions and loads
    written = inner.startswith("part-")
    own = F.when(written, F.element_at(F.split(folder, "/"), -1)).otherwise(inner)
    return files.withColumns({
        "dataset_path": F.when(written, folder).otherwise(F.col("path")),
        "stem": F.regexp_extract(own, r"^(.*?)(\.[^.]*)?$", 1),
        "suffix": F.lower(F.regexp_extract(own, r"\.([^.]*)$", 1)),
    })


def best_sources(files: DataFrame, era: Column) -> DataFrame:
    """One path for each dataset name: current before historical, then the better format, then path order.

    ``era`` gives ``current`` or ``historical`` for a row of ``with_names``.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair]), F.col("suffix"))
    ranked = files.withColumn("era", era).withColumn("format_rank", rank).where("format_rank is not null")
    ranked = ranked.select("stem", "dataset_path", "suffix", "era", "format_rank").distinct()
    order = Window.partitionBy("stem").orderBy(F.when(F.col("era") == "current", 0).otherwise(1), "format_rank", "dataset_path")
    return ranked.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "format_rank")


def read_all(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All datasets of a folder by stem, sorted."""
    rows = best_sources(with_names(listing(spark, root)), F.lit("current")).orderBy("stem").collect()  # a row for each dataset
    found = {r["stem"]: read(spark, r["dataset_path"], r["suffix"]) for r in rows}
    return {k: v for k, v in found.items() if v is not None}


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none if it isn't there."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()) if fs.exists(root) else []


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files in a folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table."""
    names = [name for name in folders(spark, path) if name.startswith("version=")]
    return [int(name.split("=")[1]) for name in names if exists(spark, f"{path}/{name}/_SUCCESS")]


def version_path(path: str, number: int) -> str:
    return f"{path}/version={number:09d}"


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    done = versions(spark, path)
    return spark.read.parquet(version_path(path, done[-1])) if done else None


def write_version(df: DataFrame, path: str, keep: int = 2) -> int:
    """Writes the next version beside the old ones, of which the last ``keep`` stay; readers never see half of one."""
    spark = df.sparkSession
    done = versions(spark, path)
    number = done[-1] + 1 if done else 0
    df.write.mode("overwrite").parquet(version_path(path, number))
    for old in [*done, number][:-keep]:
        remove(spark, version_path(path, old))
    return number


def read_first(spark: SparkSession, name: str, roots: Iterable[str]) -> DataFrame | None:
    """The dataset from the first root that has it in any format, best format first."""
    for root in roots:
        for suffix in FORMATS:
            for path in (f"{root}/{name}.{suffix}", *([f"{root}/{name}"] if suffix == "parquet" else [])):
                if exists(spark, path) and (found := read(spark, path, suffix)) is not None:
                    return found
    return None


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Writes and returns the path."""
    writer = df.write.mode(mode).format(FORMATS[fmt])
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    return path


def write_all_formats(df: DataFrame, root: str, name: str) -> dict[str, str]:
    """The dataset in every format that the session can write; computed once."""
    df = df.persist()
    try:
        kinds = ["csv", "parquet", "jsonl"] + (["avro"] if has_avro(df.sparkSession) else [])
        return {k: write(df, f"{root}/{name}.{k}", k) for k in kinds}
    finally:
        df.unpersist()


def append(df: DataFrame, path: str, schema: StructType, fmt: str = "parquet") -> str:
    """Appends to a landing folder after a cast to its schema; columns it lacks become NULL."""
    cast = [(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    return write(df.select(*cast), path, fmt, mode="append")


def write_partitions(df: DataFrame, path: str, date_col: str = "_ingested_at", year: int = 2024, month: int = 1) -> DataFrame:
    """Year and month folders; each touched one is replaced. Rows without a date go to the default. Returns the partitions written."""
    when = F.col(date_col).try_cast("timestamp")
    parts = df.withColumns({"year": F.coalesce(F.year(when), F.lit(year)), "month": F.coalesce(F.month(when), F.lit(month))})
    # All rows of a partition are written by tasks of one shuffle, so files stay few.
    parts.repartition("year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)
    return parts.groupBy("year", "month").agg(F.count("*").alias("n"))


def submissions_since(spark: SparkSession, landing: str, since: str, schema: StructType | str, date_col: str = "submission_date") -> DataFrame:
    """Landed submissions from a date on."""
    return spark.read.schema(schema).json(landing).where(F.col(date_col) >= F.lit(since))

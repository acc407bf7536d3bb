"""Bronze layer: lineage, load decisions, incremental append, watermarks and the run log."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarisk.functions.cleaning import null_sentinel
from tamarisk.sources import files, loads
from tamarisk.sources.shared import cut

log = logging.getLogger(__name__)
WATERMARKS = "dataset string, checksum string, watermark timestamp, row_count long"
RUNS = "run_id string, ts timestamp, load_type string, elapsed_s double, status string, datasets array<string>"


def add_lineage(df: DataFrame, source_file: str | Column, era: str, kind: str, now: str, load_type: str, layer: str = "bronze") -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.withColumns({
        "_source_file": text(source_file), "_source_era": F.lit(era), "_source_type": F.lit(kind),
        "_ingested_at": F.lit(now).cast("timestamp"), "_load_type": F.lit(load_type), "_layer": F.lit(layer),
    })


#: Bytes of a file that one task reads whole for its digest.
WHOLE_BYTES = 64 << 20


def line_digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, h``: digest of each file's contents, read in blocks by many tasks.

    The bytes between two newlines are a line, in any kind of file. Two sums of hashes of each line and its number stand
    for all of them, whatever the blocks are, with the file's length. The first pass counts the lines of each block, which
    gives the second their numbers. Files that Spark unpacks as it reads (``.gz``) are read by one task.
    """
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"),
    )
    blocks = cut(lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n")))  # a row for each block
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(F.broadcast(blocks.select("path", "block", "first", before.alias("before"))), ["path", "block"])
    number = F.col("at") - F.col("first") + F.col("before")
    halves = [F.sum(F.xxhash64(F.lit(seed), number, "line").cast("decimal(20,0)")).alias(f"h{seed}") for seed in (1, 2)]
    sums = numbered.groupBy("path", "size").agg(F.count("*").alias("lines"), *halves)
    return sums.select("path", F.md5(F.concat_ws(" ", "size", "lines", "h1", "h2").cast("binary")).alias("h"))


def checksums(spark: SparkSession, *roots: str) -> DataFrame:
    """``stem, dataset_path, suffix, checksum``: digest over the contents of a dataset's files in path order.

    Files of up to ``WHOLE_BYTES`` are read as one value; those beyond it in blocks, by ``line_digests``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = reader.load(list(roots)).where(~F.element_at(F.split("path", "/"), -1).rlike("^[._]"))
    digests = rows.where(F.col("length") <= WHOLE_BYTES).select("path", F.md5("content").alias("h"))
    large = [r["path"] for r in rows.where(F.col("length") > WHOLE_BYTES).select("path").collect()]  # a path for each large file
    if large:
        digests = digests.unionByName(line_digests(spark, large))
    found = files.with_names(digests)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"]), "")
    return found.groupBy("stem", "dataset_path", "suffix").agg(F.md5(parts.cast("binary")).alias("checksum"))


def load_types(sources: DataFrame, watermarks: DataFrame, force_full: bool = False) -> DataFrame:
    """``full_load`` without a stored checksum, ``incremental`` if it differs, ``cdc`` (nothing to do) if it is the same."""
    old = watermarks.select(F.col("dataset").alias("stem"), F.col("checksum").alias("_old"))
    kind = F.when(F.lit(force_full) | F.col("_old").isNull(), "full_load").when(F.col("_old") != F.col("checksum"), "incremental").otherwise("cdc")
    return sources.join(old, "stem", "left").withColumn("load_type", kind).drop("_old")


def newer_than(df: DataFrame, watermark: Column | str, at: str = "_ingested_at") -> DataFrame:
    """Rows after the watermark; a missing watermark lets all pass."""
    mark = F.lit(watermark).cast("timestamp") if isinstance(watermark, str) else watermark
    return df.where(mark.isNull() | (F.col(at) > mark))


def clean_sentinels(df: DataFrame) -> DataFrame:
    return df.withColumns({c: null_sentinel(f"`{c}`") for c, kind in df.dtypes if kind == "string"})


def updated_watermarks(watermarks: DataFrame, loads: DataFrame) -> DataFrame:
    """The control table with the rows of this run in place of the old ones."""
    from tamarisk.operators.scd import upsert

    return upsert(watermarks, loads, "dataset", "watermark")


def with_run(history: DataFrame, run: DataFrame, keep: int = 100) -> DataFrame:
    """The run log with one more run, newest ``keep`` only (a control table of that many rows)."""
    order = Window.orderBy(F.col("ts").desc(), F.col("run_id").desc())
    return history.unionByName(run).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def ingest(spark: SparkSession, raw: str, bronze: str, watermarks: DataFrame, now: str, era: Column | None = None, force_full: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """All datasets of ``raw`` into ``bronze``: new and changed ones are loaded (changed ones as one load more), others read from there.

    A load is known by the file's checksum and the watermark that it follows: a run that died before the
    watermarks were written is run again without loading anything twice. A dataset that fails is logged and
    left out. Returns the tables and the new watermarks.
    """
    era = era if era is not None else F.when(F.col("dataset_path").contains("/historical/"), "historical").otherwise("current")
    best = files.best_sources(files.with_names(files.listing(spark, raw)), era)
    kinds = load_types(best.join(checksums(spark, raw).select("dataset_path", "checksum"), "dataset_path"), watermarks, force_full)
    kinds = kinds.join(watermarks.select(F.col("dataset").alias("stem"), F.col("checksum").alias("last"), F.col("watermark").cast("string")), "stem", "left")
    tables: dict[str, DataFrame] = {}
    done = []
    for r in kinds.orderBy("stem").collect():  # a row for each dataset
        path = f"{bronze}/{r['stem']}"
        try:
            if r["load_type"] != "cdc" or not loads.committed(spark, path):
                df = files.read(spark, r["dataset_path"], r["suffix"])
                if df is None:
                    continue
                names = {c: c.replace(".", "_") for c in df.columns if "." in c}
                rows = loads.input_order(df).withColumnsRenamed(names)
                rows = clean_sentinels(add_lineage(rows, r["dataset_path"], r["era"], r["suffix"], now, r["load_type"]))
                replaces = r["load_type"] != "incremental"
                load = loads.load_id(r["last"], r["watermark"], r["checksum"], now if force_full else None)
                loads.write(rows, path, load, replaces)
                loads.compact(spark, path)
                done.append((r["stem"], r["checksum"]))
            tables[r["stem"]] = loads.read(spark, path)
        except Exception as error:  # one bad dataset doesn't stop the others
            log.warning("dataset %s failed: %s", r["stem"], error)
    return tables, updated_watermarks(watermarks, watermark_rows(spark, done, tables, now))


def watermark_rows(spark: SparkSession, done: list[tuple[str, str]], tables: Mapping[str, DataFrame], now: str) -> DataFrame:
    rows = [(name, checksum, tables[name].count()) for name, checksum in done if name in tables]
    df = spark.createDataFrame(rows, "dataset string, checksum string, row_count long")
    return df.select("dataset", "checksum", F.lit(now).cast("timestamp").alias("watermark"), "row_count")

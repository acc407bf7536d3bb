"""Tables made of loads: each load is a folder of its own, and a manifest names the loads that count.

A load is written first and then committed by one file, so a run that dies in between leaves no
trace in the table, and a load that is committed is not written again. The manifests are numbered;
readers take the last one. Folders under a table: ``load=<id>`` and ``_manifest``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.sources import files


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Paths of the manifests, oldest first."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return [f"{path}/_manifest/{n}" for n in sorted(names) if n.endswith(".json") and n[0] not in "._"]


def _loads_of(spark: SparkSession, manifest: str) -> list[str]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def committed(spark: SparkSession, path: str) -> list[str]:
    """Ids of the loads of a table, in the order of their commits."""
    found = _manifests(spark, path)
    return _loads_of(spark, found[-1]) if found else []


def commit(spark: SparkSession, path: str, loads: list[str]) -> None:
    """Makes these the loads of the table. What only older manifests than the last two name is removed."""
    before = _manifests(spark, path)
    number = int(before[-1].rpartition("/")[2].split(".")[0]) + 1 if before else 0
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    draft, final = fs_path(f"{path}/_manifest/.{number:09d}.draft"), fs_path(f"{path}/_manifest/{number:09d}.json")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(loads).encode()))
    finally:
        stream.close()
    if not fs.rename(draft, final):
        raise OSError(f"another run has committed {final}")
    held = {*loads, *(_loads_of(spark, before[-1]) if before else [])}
    for old in before[:-1]:
        files.remove(spark, old)
    for name in files.folders(spark, path):
        if name.startswith("load=") and name.removeprefix("load=") not in held:
            files.remove(spark, f"{path}/{name}")


def write(df: DataFrame, path: str, load: str, replace: bool = False) -> bool:
    """Writes and commits a load, as the only one or after the others; False if it is committed already."""
    spark = df.sparkSession
    before = committed(spark, path)
    if load in before:
        return False
    df.write.mode("overwrite").parquet(f"{path}/load={load}")
    commit(spark, path, [load] if replace else [*before, load])
    return True


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed rows; columns that came later are NULL in older loads."""
    found = committed(spark, path)
    return spark.read.option("mergeSchema", True).parquet(*[f"{path}/load={x}" for x in found]) if found else None


def compact(spark: SparkSession, path: str, most: int = 64) -> None:
    """One load in place of all, where there are more than ``most``."""
    found = committed(spark, path)
    if len(found) > most:
        name = f"{found[-1]}-all"
        read(spark, path).write.mode("overwrite").parquet(f"{path}/load={name}")
        commit(spark, path, [name])


def tables_in(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The table of each folder that has a committed load, by name."""
    found = {name: read(spark, f"{root}/{name}") for name in files.folders(spark, root) if name[0] not in "._"}
    return {k: v for k, v in found.items() if v is not None}


def load_id(*parts: object) -> str:
    """A name for a load, from what tells it from others."""
    from hashlib import md5

    return md5(json.dumps([None if p is None else str(p) for p in parts]).encode()).hexdigest()


def input_order(df: DataFrame) -> DataFrame:
    """Rows just read from files with ``_input_order``: file, block in the file, and place among the rows of the task that reads the block."""
    meta = F.col("_metadata")
    return df.select("*", F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")).alias("_input_order"))

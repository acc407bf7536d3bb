"""The whole run, or some of its layers: raw files to Bronze, Silver and Gold, with control tables and a run log.

Folders under ``root``: ``bronze`` holds the committed loads of each dataset, ``silver``, ``changes`` and
``gold`` versions of each table, ``control`` the watermarks, the counts of fixes and the run log.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from datetime import datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tamarisk.operators import bronze, gold, silver
from tamarisk.operators.watch import FIXES, table_of
from tamarisk.sources import files, loads

LAYERS = ("bronze", "silver", "gold")
Tables = dict[str, DataFrame]


def control(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A control table as the last run left it."""
    found = files.latest_version(spark, f"{root}/control/{name}")
    return spark.createDataFrame([], schema) if found is None else found


def run(
    spark: SparkSession, raw: str, root: str, layers: Sequence[str] = LAYERS, force_full: bool = False, now: str | None = None, run_id: str | None = None
) -> dict[str, Tables]:
    """Builds the layers named, each from the one before as it is on disk, and returns the tables of these layers.

    The run is logged whether it succeeds or fails; a failure is raised after that.
    """
    unknown = set(layers) - set(LAYERS)
    if unknown:
        raise ValueError(f"unknown layers: {sorted(unknown)}")
    now, started = now or datetime.now().isoformat(" ", "seconds"), time.monotonic()
    out: dict[str, Tables] = {}
    status = "failed"
    try:
        if "bronze" in layers:
            out["bronze"] = run_bronze(spark, raw, root, now, force_full)
        if "silver" in layers:
            out["silver"] = run_silver(spark, root, now, force_full)
        if "gold" in layers:
            out["gold"] = run_gold(spark, root, now)
        status = "success"
    finally:
        names = sorted({name for tables in out.values() for name in tables})
        kind = "full_load" if force_full else "incremental"
        row = [(run_id or uuid4().hex, now, kind, time.monotonic() - started, status, names)]
        log = spark.createDataFrame(row, "run_id string, ts string, load_type string, elapsed_s double, status string, datasets array<string>")
        history = control(spark, root, "runs", bronze.RUNS)
        files.write_version(bronze.with_run(history, log.withColumn("ts", log["ts"].cast("timestamp"))), f"{root}/control/runs")
    return out


def run_bronze(spark: SparkSession, raw: str, root: str, now: str, force_full: bool = False) -> Tables:
    marks = control(spark, root, "watermarks", bronze.WATERMARKS)
    tables, marks = bronze.ingest(spark, raw, f"{root}/bronze", marks, now, force_full=force_full)
    files.write_version(marks, f"{root}/control/watermarks")
    return tables


#: What each Silver version was made from.
MADE_FROM = "dataset string, version long, loads array<string>"


def run_silver(spark: SparkSession, root: str, now: str, force_full: bool = False) -> Tables:
    """Cleaned tables as new versions, what changed in each against the version before, and what was fixed.

    A table with a key whose Bronze has the loads that its newest version was made from stays as it is, with an empty
    version of changes: all its rows would keep their values and tags. ``force_full`` makes it anew.
    """
    sources = loads.tables_in(spark, f"{root}/bronze")
    before = {name: found for name in sources if (found := files.latest_version(spark, f"{root}/silver/{name}")) is not None}
    held = {name: loads.committed(spark, f"{root}/bronze/{name}") for name in sources}
    made = {r["dataset"]: (r["version"], r["loads"]) for r in control(spark, root, "made_from", MADE_FROM).collect()}  # a row for each dataset
    newest = {name: files.versions(spark, f"{root}/silver/{name}")[-1] for name in before}
    same = {} if force_full else {name: df for name, df in before.items() if silver.key_of(df) and made.get(name) == (newest[name], held[name])}
    out, watches = dict(same), {}
    fixes = [tuple(r) for r in control(spark, root, "fixes", FIXES).collect() if r["dataset"] in same]
    for name in same:
        files.write_version(spark.createDataFrame([], "key string, _cdc_op string"), f"{root}/changes/{name}")
    for name, df in silver.build({k: x for k, x in sources.items() if k not in same}, now, before, watches).items():
        files.write_version(df, f"{root}/silver/{name}")
        out[name] = files.latest_version(spark, f"{root}/silver/{name}")
        found = silver.changes(before.get(name), out[name])
        if found is not None:
            files.write_version(found, f"{root}/changes/{name}")
        fixes += [(name, issue, n) for issue, n in watches[name].counts(out[name].count()).items()]
    files.write_version(table_of(spark, fixes), f"{root}/control/fixes")
    made_from = [(name, files.versions(spark, f"{root}/silver/{name}")[-1], held[name]) for name in out]
    files.write_version(spark.createDataFrame(made_from, MADE_FROM), f"{root}/control/made_from")
    return {name: out[name] for name in sources}


def run_gold(spark: SparkSession, root: str, now: str) -> Tables:
    sources = loads.tables_in(spark, f"{root}/bronze")
    cleaned = {name: found for name in sources if (found := files.latest_version(spark, f"{root}/silver/{name}")) is not None}

    def save(name: str, df: DataFrame) -> DataFrame:
        files.write_version(df, f"{root}/gold/{name}")
        return files.latest_version(spark, f"{root}/gold/{name}")

    return gold.build(cleaned, sources, spark, now, control(spark, root, "fixes", FIXES), save)

"""Whole runs, versions, streams, map and tables: values, second loads, retries and failures."""

import hashlib
import math
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tamarisk.operators import bronze, geospatial, governance, pipeline, scd, serving, silver
from tamarisk.operators.watch import Watch
from tamarisk.sources import files, loads, shared, tables, warehouse
from tamarisk.streaming import submissions as stream


def households(spark, path, rows):
    df = spark.createDataFrame(rows, "household_id string, district string, consent_given string, household_size string")
    files.write(df, f"{path}/current/households.csv", "csv")


def test_runs_changes_and_log(spark, tmp_path):
    raw, root = f"{tmp_path}/raw", f"{tmp_path}/data"
    households(spark, raw, [("1", "LAHORE", "yes", "4"), ("2", "lahore", "yes", "5"), ("3", "Karachi", "no", "6"), ("4", "Quetta", "yes", "nan")])
    first = pipeline.run(spark, raw, root, now="2024-01-01", run_id="a")
    assert {r["household_id"]: r["_cdc_op"] for r in first["silver"]["households"].collect()} == dict.fromkeys(("1", "2", "4"), "INSERT")
    households(spark, raw, [("1", "LAHORE", "yes", "4"), ("2", "lahore", "yes", "9"), ("3", "Karachi", "yes", "6")])
    second = pipeline.run(spark, raw, root, now="2024-01-02", run_id="b")
    rows = {r["household_id"]: (r["_cdc_op"], str(r["_cdc_ts"])[:10], r["household_size"]) for r in second["silver"]["households"].collect()}
    assert rows == {"1": ("INSERT", "2024-01-01", 4.0), "2": ("UPDATE", "2024-01-02", 9.0), "3": ("INSERT", "2024-01-02", 6.0), "4": ("INSERT", "2024-01-01", None)}
    found = {r["key"]: r["_cdc_op"] for r in files.latest_version(spark, f"{root}/changes/households").collect()}
    assert found == {"2": "UPDATE", "3": "INSERT"}
    # A full load replaces what was appended: household 4 is gone.
    third = pipeline.run(spark, raw, root, ["bronze", "silver"], force_full=True, now="2024-01-03", run_id="c")
    assert {r["household_id"] for r in third["silver"]["households"].collect()} == {"1", "2", "3"}
    assert {r["key"]: r["_cdc_op"] for r in files.latest_version(spark, f"{root}/changes/households").collect()} == {"4": "DELETE"}
    status = {(r["layer"], r["dataset"]): r["rows"] for r in second["gold"]["rpt_pipeline_status"].collect()}
    assert status["bronze", "households"] == 7 and status["silver", "households"] == 4 and status["gold", "dim_district"] == 36
    log = pipeline.control(spark, root, "runs", bronze.RUNS).orderBy("ts").collect()
    assert [(r["run_id"], r["status"], r["load_type"]) for r in log] == [("a", "success", "incremental"), ("b", "success", "incremental"), ("c", "success", "full_load")]
    assert files.versions(spark, f"{root}/silver/households") == [1, 2]


def test_failed_run_is_logged(spark, tmp_path, monkeypatch):
    def fail(*_):
        raise RuntimeError("no gold today")

    monkeypatch.setattr(pipeline, "run_gold", fail)
    with pytest.raises(RuntimeError):
        pipeline.run(spark, "", str(tmp_path), ["gold"], now="2024-01-01")
    assert [r["status"] for r in pipeline.control(spark, str(tmp_path), "runs", bronze.RUNS).collect()] == ["failed"]
    with pytest.raises(ValueError):
        pipeline.run(spark, "", str(tmp_path), ["platinum"])


def test_changes_need_a_key(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert silver.changes(None, df) is None and silver.key_of(df) is None


def test_batches_can_be_run_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, []), (2, ["age missing"])], "id int, errors array<string>")
    split = stream.split_valid(f"{tmp_path}/valid", f"{tmp_path}/bad")
    for batch in (0, 0, 1):
        split(rows, batch)
    assert spark.read.parquet(f"{tmp_path}/valid").count() == 2 and spark.read.parquet(f"{tmp_path}/bad").count() == 2


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path, kind = f"{tmp_path}/table", "id long, at int, x string"
    merge = stream.upsert_batches(path, "id", "at", "t", "2024-01-01", buckets=8)
    merge(spark.createDataFrame([(i, 1, "a") for i in range(100)], kind), 0)
    for batch in (1, 1, 2, 3):
        merge(spark.createDataFrame([(7, 1 + batch, f"b{batch}"), (8, 0, "late")], kind), batch)
    held = stream.bucket_versions(spark, path)
    assert sum(numbers == [0] for numbers in held.values()) >= 6 and max(map(len, held.values())) == 2
    out = {r["id"]: (r["x"], r["_cdc_op"]) for r in stream.current_version(spark, path).collect()}
    assert len(out) == 100 and out[7] == ("b3", "UPDATE") and out[8] == ("a", "INSERT")


@pytest.mark.parametrize("few", [20_000, 1])
def test_nearest_facility_of_odd_places(spark, monkeypatch, few):
    monkeypatch.setattr(geospatial, "BROADCAST_FACILITIES", few)
    homes = spark.createDataFrame([(1, 30.0, 70.0), (2, float("nan"), 70.0), (3, float("inf"), 70.0), (4, None, 70.0), (5, 30.4, 70.4)], "household_id int, gps_latitude double, gps_longitude double")
    sites = spark.createDataFrame([(10, 30.01, 70.01), (11, 36.0, 61.0), (12, float("nan"), 61.0)], "facility_id int, gps_latitude double, gps_longitude double")
    out = {r["household_id"]: (r["nearest_facility"], r["within_catchment"]) for r in geospatial.nearest_facility(homes, sites).collect()}
    assert out == {1: (10, True), 3: (None, None), 5: (10, False)}  # NaN is no place
    assert {r["nearest_facility"] for r in geospatial.nearest_facility(homes, sites.limit(0)).collect()} == {None}


def test_table_upsert_fails_whole(spark):
    url = "jdbc:derby:memory:half;create=true"
    df = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id int, name string")
    tables.load(df, url, "t", "replace")
    with pytest.raises(Exception):  # noqa: B017
        tables.statement(spark, url, "DELETE FROM t WHERE \"id\" < 10", "INSERT INTO nowhere VALUES (1)")
    out = tables.read(spark, url, "t", "id", 4)
    assert out.rdd.getNumPartitions() == 4 and sorted(r["id"] for r in out.collect()) == list(range(20))


def test_listing_checksums_and_statistics(spark, tmp_path):
    """Exact values of the three queries that SQL can't express."""
    (tmp_path / "a.csv").write_bytes(b"x,y\n1,2\n")
    (tmp_path / "b.json").write_bytes(b"{}")
    (tmp_path / "c.parquet").mkdir()
    for i in (1, 0):
        (tmp_path / "c.parquet" / f"part-{i}.parquet").write_bytes(b"part" * (i + 1))
    found = {r["path"].rpartition("/")[2]: r["length"] for r in files.listing(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": 8, "b.json": 2, "part-0.parquet": 4, "part-1.parquet": 8}
    md5 = lambda x: hashlib.md5(x).hexdigest()
    sums = {r["stem"]: r["checksum"] for r in bronze.checksums(spark, str(tmp_path)).collect()}
    assert sums == {"a": md5(md5(b"x,y\n1,2\n").encode()), "b": md5(md5(b"{}").encode()), "c": md5((md5(b"part") + md5(b"partpart")).encode())}
    stats = {r["dataset"]: (r["files"], r["kb"]) for r in serving.layer_statistics(spark, {"raw": str(tmp_path)}).collect()}
    assert stats == {"a": (1, 0.0), "b": (1, 0.0), "c": (2, 0.0)}
    seen = {r["dataset"]: (r["rows"], r["columns"]) for r in serving.layer_statistics(spark, {"raw": str(tmp_path)}).collect()}
    assert seen["a"] == (1, 2) and seen["c"] == (None, None)  # no Parquet file at all


def test_codebook_counts(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(10)], "household_id int, district string")
    out = {r["field"]: r for r in governance.codebook(df, "h").collect()}
    assert (out["household_id"]["n_distinct"], out["district"]["n_distinct"]) == (10, 1) and math.isclose(out["district"]["missing_pct"], 50)


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError):
        shared.checkpoint_dir(Session())


def test_entry_hides_missing_parts_only(tmp_path):
    """Without the optional parts the entry imports; a broken import inside them is an error."""
    root = Path(__file__).parent.parent
    for name in ("__spark_entry__.py", "tamarisk"):
        (tmp_path / name).symlink_to(root / name)
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""}).returncode
    assert run("import __spark_entry__ as e; assert len(e.queries()) > 100 and 'pipeline' not in e.queries()") == 0
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    assert run("import __spark_entry__") != 0


def test_kinds_of_columns_survive_a_cut(spark):
    assert shared.cut(spark.range(3).withColumn("x", F.lit("a"))).schema.simpleString() == "struct<id:bigint,x:string>"


def test_killed_run_loads_nothing_twice(spark, tmp_path, monkeypatch):
    """A run that dies between the load and the watermarks, or within the load, gives the same table when it is run again."""
    raw, root = f"{tmp_path}/raw", f"{tmp_path}/data"
    count = lambda: loads.read(spark, f"{root}/bronze/households").count()
    households(spark, raw, [(str(i), "Lahore", "yes", "4") for i in range(5)])
    pipeline.run(spark, raw, root, ["bronze"], now="2024-01-01")
    households(spark, raw, [(str(i), "Lahore", "yes", "9") for i in range(3)])
    write_version = files.write_version

    def dies(df, path, *more):
        if path.endswith("watermarks"):
            raise RuntimeError("killed")
        return write_version(df, path, *more)

    for broken in ("watermarks", "commit"):
        with monkeypatch.context() as m:
            if broken == "watermarks":
                m.setattr(files, "write_version", dies)
                with pytest.raises(RuntimeError):
                    pipeline.run(spark, raw, root, ["bronze"], now="2024-01-02")
            else:
                households(spark, raw, [(str(i), "Lahore", "yes", "1") for i in range(2)])
                m.setattr(loads, "commit", lambda *_: 1 / 0)
                pipeline.run(spark, raw, root, ["bronze"], now="2024-01-04")  # logged, others go on
                assert count() == 8
        pipeline.run(spark, raw, root, ["bronze"], now="2024-01-03" if broken == "watermarks" else "2024-01-05")
        assert count() == {"watermarks": 8, "commit": 10}[broken]
    assert len(loads.committed(spark, f"{root}/bronze/households")) == 3
    loads.compact(spark, f"{root}/bronze/households", most=2)
    assert count() == 10 and len(loads.committed(spark, f"{root}/bronze/households")) == 1
    # The same contents again after others are a load of their own; a full load replaces all, and older folders go.
    households(spark, raw, [(str(i), "Lahore", "yes", "9") for i in range(3)])
    pipeline.run(spark, raw, root, ["bronze"], now="2024-01-06")
    assert count() == 13
    for day in (7, 8):
        pipeline.run(spark, raw, root, ["bronze"], force_full=True, now=f"2024-01-{day:02d}")
    assert count() == 3 and len([x for x in files.folders(spark, f"{root}/bronze/households") if x.startswith("load=")]) == 2


def test_reload_of_a_dataset_without_a_key(spark, tmp_path):
    raw, root = f"{tmp_path}/raw", f"{tmp_path}/data"
    log = [("E001", "2024-01-01", "10"), ("E002", "2024-01-01", "7")]
    write = lambda rows: files.write(spark.createDataFrame(rows, "enumerator_id string, date string, submissions string"), f"{raw}/current/enumerator_performance.csv", "csv")
    write(log)
    pipeline.run(spark, raw, root, now="2024-01-01")
    write([*log, ("E001", "2024-01-02", "5")])
    out = pipeline.run(spark, raw, root, now="2024-01-02")
    assert sorted((r["enumerator_id"], r["submissions"]) for r in out["silver"]["enumerator_performance"].collect()) == [("E001", 5.0), ("E001", 10.0), ("E002", 7.0)]
    report = {r["dataset"]: r for r in out["gold"]["rpt_data_quality"].collect()}
    assert report["enumerator_performance"]["dq_fixes_applied"] == 0
    assert files.versions(spark, f"{root}/gold/rpt_data_quality") == [0, 1]  # readers of the older one aren't disturbed


def test_first_row_of_a_file_wins(spark, tmp_path):
    """Also against a smaller digest, in every format, and over several files."""
    rows = spark.createDataFrame([("1", f"r{i:03d}", str(i % 7)) for i in range(200)], "visit_id string, note string, household_id string").coalesce(1)
    for fmt in ("csv", "json", "parquet"):
        path = f"{tmp_path}/{fmt}"
        files.write(rows, path, fmt)
        files.write(rows.where("note < 'r005'").replace({"r000": "later"}), path, fmt, "append")
        first = [f for f in sorted(os.listdir(path)) if f.startswith("part-")][0]
        found = silver.clean("followup_visits", loads.input_order(files.read(spark, path, fmt))).collect()
        assert [r["note"] for r in found] == [files.read(spark, f"{path}/{first}", fmt).first()["note"]]
    many = scd.first_by_key(loads.input_order(files.read(spark, f"{tmp_path}/csv", "csv")), "visit_id")
    assert "WindowGroupLimit" in many._jdf.queryExecution().executedPlan().toString()  # one row of a hot key from each task


def test_counts_without_data_pages(spark, tmp_path):
    path = files.write(spark.range(1000), f"{tmp_path}/t.parquet")
    with serving.footer_counts(spark):
        plan = serving.as_read(spark, path, "parquet").agg(F.count("*"))
        assert plan.first()[0] == 1000
        text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in text and "ReadSchema: struct<count(*):bigint>" in text
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


@pytest.mark.parametrize("lost", [0, 3])
def test_watch_counts_again_after_a_loss(spark, tmp_path, lost):
    """Counts are those of one pass, also if rows passed a point twice."""
    raw = spark.createDataFrame([(str(i % 8), "lahor", "yes", "4") for i in range(20)] + [(None, "x", "no", "1")], "household_id string, district string, consent_given string, household_size string")
    watch = Watch()
    out = silver.clean_households(raw.withColumn("submission_time", F.lit("2024-01-01")), watch)
    n = out.write.format("noop").mode("overwrite").save() or out.count()
    assert n == 8
    if lost:
        watch._points[-1][1].count()
        real = watch._points[-1][0]

        class Twice:
            get = real.get | {"rows": n + lost, "district_normalised": 99}

        watch._points[-1] = (Twice(), *watch._points[-1][1:])
    found = watch.counts(n)
    assert found["missing_hh_id_dropped"] == 1 and found["duplicates_removed"] == 12 and found["district_normalised"] == 8 and found["no_consent_dropped"] == 0


def test_buckets_split_as_they_grow(spark, tmp_path):
    """Every key stays findable once, also where a batch is run again after a split, and a batch of one key writes a small part."""
    path, kind = f"{tmp_path}/table", "id long, at int, x string"
    merge = stream.upsert_batches(path, "id", "at", "t", "2024-01-01", buckets=2, bucket_bytes=6_000)
    truth = {}
    for batch in (0, 1, 1, 2, 3, 4, 5, 5, 6):
        ids = range(batch * 100, batch * 100 + 700, 1 + batch % 2)
        merge(spark.createDataFrame([(i, batch, f"text {i} of batch {batch}") for i in ids], kind), batch)
        truth |= {i: batch for i in ids}
        assert {r["id"]: r["at"] for r in stream.current_version(spark, path).collect()} == truth
        assert stream.current_version(spark, path).count() == len(truth)
    labels = stream._leaves(stream.bucket_versions(spark, path))
    assert len(labels) > 4 and len({b.split("-")[0] for b in labels}) >= 1
    merge(spark.createDataFrame([(7, 99, "one")], kind), 7)
    assert len([x for x in files.folders(spark, files.version_path(path, 7)) if x.startswith("key_bucket")]) <= 2
    with pytest.raises(ValueError):
        stream.upsert_batches(path, "id", "at", "t", "2024-01-01", buckets=3)


def test_sliding_windows_copy_sums_only(spark, tmp_path):
    """30 windows hold each day's sum, not each row: state stays far below 30 rows for each row."""
    rows = spark.range(3_000).selectExpr("timestamp_seconds(1704067200 + id * 60) as at", "'a' as k", "cast(id % 7 as double) as v")
    landed = files.write(rows, f"{tmp_path}/in", "json")
    found = stream.sliding_rate(stream.landed(spark, landed, rows.schema), "at", "k", "v", "1 day")
    run = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    assert max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in run.recentProgress) <= 40


def test_catalog_tables(spark, tmp_path):
    """Modes of a load, no rows, an upsert of a few parts that leaves the files of all others, and a repeated one."""
    rows = spark.range(1_000).selectExpr("id", "concat('n', id) as name")
    to = {"table": "people", "path": f"{tmp_path}/people"}
    assert warehouse.load(rows, if_exists="fail", key="id", parts=16, **to) == 1_000
    with pytest.raises(Exception, match="already exists"):
        warehouse.load(rows, if_exists="fail", key="id", parts=16, **to)
    assert warehouse.load(rows.limit(0), if_exists="replace", key="id", parts=16, **to) == 0
    files_of = lambda: {r["path"] for r in files.listing(spark, to["path"]).where("path like '%/part-%'").select("path").collect()}
    before = files_of()
    fresh = spark.createDataFrame([(5, "new", 1), (5, "newer", 2), (5_000, "more", 1), (None, "nobody", 1)], "id long, name string, at int")
    for _ in range(2):
        assert warehouse.upsert(fresh.where("id is not null"), "people", "id", "at", parts=16) == 2
    out = {r["id"]: r["name"] for r in warehouse.read(spark, "people").collect()}
    assert len(out) == 1_001 and out[5] == "newer" and out[5_000] == "more" and out[6] == "n6"
    assert len(before & files_of()) >= 0.8 * len(before)
    assert warehouse.upsert(fresh.limit(0), "people", "id", parts=16) == 0
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static").lower() == "static"
    assert tables.load(rows.limit(0), "jdbc:derby:memory:none;create=true", "t", "replace") == 0


@pytest.mark.parametrize("few", [100_000, 1])
def test_each_spelling_is_resolved_once(spark, monkeypatch, few):
    """Jobs over stored rows give what the others give; the work per spelling is out of their plan."""
    monkeypatch.setattr(silver, "BROADCAST_VALUES", few)
    spellings = ["LAHORE", "lahor", " karachi ", "", None, "nowhere at all", "D.I. Khan"]
    raw = spark.createDataFrame([(str(i), f"h{i}", spellings[i % 7], "yes", "4", "50") for i in range(70)], "visit_id string, household_id string, district string, consent_given string, household_size string, readiness_score string")
    raw = raw.withColumns({"assessment_id": F.col("visit_id"), "record_id": F.col("visit_id")})
    for name in ("households", "followup_visits", "facility_assessments", "2020_anything"):
        plain, stored = silver.clean(name, raw), silver.clean(name, raw, stored=True)
        assert plain.columns == stored.columns and sorted(map(str, plain.collect())) == sorted(map(str, stored.collect()))
        text = stored._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in text and "_resolved_district" in text

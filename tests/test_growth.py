"""What must not grow faster than the tables: rows that are shuffled, and work done again."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tamarisk.functions import cleaning as C
from tamarisk.operators import bronze, gold, monitoring, pipeline, scd, silver
from tamarisk.operators.watch import FIXES
from tamarisk.plans import registry  # isort: skip  # noqa: F401  (before the modules that it imports)
from tamarisk.plans import layer_queries  # isort: skip
from tamarisk.plans.views import Views
from tamarisk.sources import files, shared
from tamarisk.streaming import submissions as stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unchanged_silver_is_left_as_it_is(spark, tmp_path):
    """a table made of the same loads isn't made again, unless that is asked for."""
    raw, root = f"{tmp_path}/raw", f"{tmp_path}/data"
    rows = [(str(i), "lahor", "yes", "4") for i in range(9)]
    write = lambda rows: files.write(spark.createDataFrame(rows, "household_id string, district string, consent_given string, household_size string"), f"{raw}/current/households.csv", "csv")
    write(rows)
    first = pipeline.run(spark, raw, root, ["bronze", "silver"], now="2024-01-01")["silver"]["households"].collect()
    fixes = pipeline.control(spark, root, "fixes", FIXES).collect()
    second = pipeline.run(spark, raw, root, ["bronze", "silver"], now="2024-01-02")["silver"]["households"].collect()
    assert sorted(first) == sorted(second) and files.versions(spark, f"{root}/silver/households") == [0]
    assert files.latest_version(spark, f"{root}/changes/households").count() == 0
    assert sorted(fixes) == sorted(pipeline.control(spark, root, "fixes", FIXES).collect()) and fixes
    pipeline.run(spark, raw, root, ["silver"], force_full=True, now="2024-01-03")
    assert files.versions(spark, f"{root}/silver/households") == [0, 1]
    write(rows[:5] + [("7", "lahor", "yes", "9")])
    third = pipeline.run(spark, raw, root, ["bronze", "silver"], now="2024-01-04")["silver"]["households"]
    assert third.where("_cdc_op = 'UPDATE'").count() == 1
    assert files.latest_version(spark, f"{root}/changes/households").collect() == [("7", "UPDATE")]


@pytest.mark.parametrize("few", [100_000, 1])
def test_rows_with_a_key_of_their_own_are_not_shuffled(spark, monkeypatch, few):
    """with repeats and without, the rows are those of ``first_by_key``."""
    monkeypatch.setattr(scd, "BROADCAST_KEYS", few)
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit("a").alias("x"), (-F.col("id")).alias("at"))
    assert "Exchange hashpartitioning" not in plan(scd.first_of_few(rows, rows, "k"))
    odd = rows.union(rows.where("k < '3'").withColumn("at", F.col("at") - 500)).union(rows.limit(3).withColumn("k", F.lit(None))).union(rows.limit(2).withColumn("k", F.lit(None)))
    for df in (odd, odd.union(odd.where("k = '5'")), odd.withColumn(scd.INPUT_ORDER, F.struct("at", "x"))):
        for order in ([], [F.col("at").asc_nulls_last()]):
            assert sorted(map(str, scd.first_of_few(df, df, "k", *order).collect())) == sorted(map(str, scd.first_by_key(df, "k", *order).collect()))


def test_visits_of_raw_files_are_shuffled_while_narrow(spark):
    """no line that makes a visit is moved as a whole visit, and each visit is there once."""
    v = Views(spark, "/root/testdata/sf0.001")
    once = v.sql("SELECT * FROM visits", lineitem=layer_queries._lines_once(v))
    assert once.count() == once.select("visit_id").distinct().count() == v("visits").select("visit_id").distinct().count()
    dearer = once.select("visit_id", F.col("l_extendedprice").alias("p")).join(v("visits").groupBy("visit_id").agg(F.min("l_extendedprice").alias("low")), "visit_id")
    assert dearer.where("p <> low").count() == 0
    assert "haz_score" not in plan(once).split("Window ")[1]


def test_repeats_are_counted_without_the_shares(spark):
    """what is shuffled for a key are the key and a count."""
    raw = spark.createDataFrame([("a", None), ("a", "x"), (None, "x"), (None, None), ("b", "x")], "household_id string, district string")
    out = gold.quality_report({"t": (raw, raw)})
    assert out.select("raw_rows", "missing_pct_raw", "duplicates_raw", "clean_rows").collect() == [(5, 40.0, 2, 5)]
    assert "distinct" not in plan(out)
    empty = gold._repeats(raw.limit(0), ["household_id"]).collect()
    assert empty == [(0,)] and gold._repeats(raw, []).collect() == [(0,)]


def test_numbers_are_told_by_their_first_letters(spark):
    texts = ["12", " -3.5", "+.5", "inf", "-Infinity", "NaN", "1e3", "abc", "e5", "", None, "\t7", "0x1p3", "9x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    told = df.where(F.col("t").rlike(gold._NUMBER_STARTS))
    assert {r["t"] for r in df.where(gold.to_double("t").isNotNull()).collect()} <= {r["t"] for r in told.collect()}
    assert "abc" not in {r["t"] for r in told.collect()}


def test_values_of_other_kinds_are_cleaned_as_their_texts(spark):
    """numbers and dates give what their texts give."""
    df = spark.sql("SELECT * FROM VALUES (1, 0, 7L, date'2024-02-29', timestamp'2024-01-02 03:04:05'), (-4, 1, -12L, date'0987-01-01', null), (null, null, null, null, null) AS t(anemia, ari_2w, enumerator_id, visit_date, at)")
    changes = {"anemia": silver.C.yes_no, "ari_2w": silver.C.yes_no, "enumerator_id": silver.C.enumerator_id, "visit_date": silver.C.parse_date, "at": silver.C.parse_date}
    texts = df.select(*[F.col(c).cast("string") for c in df.columns])
    kinds, of_texts = silver.apply(df, changes), silver.apply(texts, changes)
    assert kinds.dtypes == of_texts.dtypes and kinds.collect() == of_texts.collect()
    assert "regexp" not in plan(kinds)


def test_large_files_are_read_in_blocks(spark, tmp_path, monkeypatch):
    """no task reads a large file whole; digests tell contents apart and don't depend on the blocks."""
    monkeypatch.setattr(bronze, "WHOLE_BYTES", 100)
    base = random.Random(7).randbytes(200_000)
    odd = {"a": base, "b": base + b"\n", "c": base[:100] + bytes([base[100] ^ 1]) + base[101:], "d": b"\n".join(reversed(base.split(b"\n"))), "e": b"\xef\xbb\xbf" + base, "f": base + b"\r", "g": base, "h": base[:90]}
    for name, content in odd.items():
        (tmp_path / f"{name} %41.bin").write_bytes(content)
    sums = lambda: {r["stem"][0]: r["checksum"] for r in bronze.checksums(spark, str(tmp_path)).collect()}
    found = sums()
    assert set(found) == set(odd) and found["a"] == found["g"] and len(set(found.values())) == len(odd) - 1
    assert found["h"] == hashlib.md5(hashlib.md5(odd["h"]).hexdigest().encode()).hexdigest()
    for size in ("3000", "77777"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        try:
            assert sums() == found
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_dates_and_districts_cost_little(spark):
    """a date pattern that can't fit isn't tried, and the text of a district is made once for all its tests; results as before."""
    patterns, tried = C.DATE_PATTERNS, lambda c: F.coalesce(*[F.try_to_timestamp(C.stripped(c), F.lit(p)) for p in C.DATE_PATTERNS], C.stripped(c).try_cast("timestamp"))
    numbers = ["0", "1", "09", "012", "13", "29", "31", "32", "2022", "+12022", "12022", "-2022", "0000", "999", "1234567", " 1", "١"]
    texts = [f"{a}{x}{b}{y}{c}" for a in numbers for b in numbers for c in numbers for x, y in ("--", "//", "..", "-/")] + ["unknown", "", None, "2024-02", "2024-1-2T3:4", "\t9/3/2022\n", "9/3/22"]
    both = spark.createDataFrame([(t,) for t in texts], "t string").select(C.parse_date("t").alias("new"), tried("t").alias("old"))
    assert both.where("not new <=> old").count() == 0 and both.where("new is not null").count() > 50
    df = spark.createDataFrame([("x",)], "t string")
    assert plan(df.select(C.parse_date("t"))).count("RLIKE") >= len(patterns)
    assert plan(df.select(C.district("t"))).count("lower(") < 10


def test_tasks_take_little_where_the_session_does_not_say(spark):
    """sorts and hash tables hold what their task takes; what the session sets stays."""
    rows = spark.createDataFrame([(1, 2)], "k long, x long")
    before = {k: spark.conf.get(k, None) for k in shared.TASK_BYTES}
    visits = spark.createDataFrame([], "visit_id long, household_id long, enumerator_id long, visit_date date, record_type string, interview_duration_min int")
    try:
        for call in (lambda: scd.first_by_key(rows, "k"), lambda: monitoring.detect_anomalies(visits)):
            for k in shared.TASK_BYTES:
                spark.conf.unset(k)
            call()
            assert {k: spark.conf.get(k) for k in shared.TASK_BYTES} == {k: str(x) for k, x in shared.TASK_BYTES.items()}
            for k in shared.TASK_BYTES:
                spark.conf.set(k, "5000000")
            call()
            assert {spark.conf.get(k) for k in shared.TASK_BYTES} == {"5000000"}
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def test_a_task_orders_no_more_rows_of_a_larger_table(spark, monkeypatch):
    """where a union's children are dealt by the key already, a task takes what it aims at of each, whatever the table has."""
    monkeypatch.setattr(shared, "TASK_BYTES", dict.fromkeys(shared.TASK_BYTES, 1 << 20))
    spark = spark.newSession()
    spark.conf.set("spark.sql.shuffle.partitions", "64")

    def most(n):
        raw = spark.range(n).select(F.xxhash64("id").alias("k"), (F.col("id") % 2).alias("x")).groupBy("k").agg(F.max("x").alias("x"))
        tasks = scd.first_by_key(raw.union(raw), "k").groupBy(F.spark_partition_id()).count().collect()
        assert sum(t["count"] for t in tasks) == n
        return max(t["count"] for t in tasks)

    assert most(1_600_000) < 1.5 * most(400_000)


def test_lines_are_put_in_order_by_as_many_tasks_as_there_are_parts(spark):
    """the rows that a task sorts before they are written don't grow with the table."""
    conf = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, x in conf.items():
            spark.conf.set(k, x)
        found = registry.QUERIES["sv22_input_order"](spark, "/root/testdata/sf0.001")
        assert len(found.inputFiles()) > 4
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_a_batch_writes_few_files(spark, tmp_path):
    """files of a batch go by its buckets, not by its buckets times its tasks; a bucket of many rows is written by several tasks."""
    spark = spark.newSession()
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream
    rows = spark.range(3000).select("id", (F.col("id") * 2).alias("at"))
    for name, most in (("a", 1_000_000), ("b", 100)):
        before, stream.FILE_ROWS = stream.FILE_ROWS, most
        try:
            merge = stream.upsert_batches(f"{tmp_path}/{name}", "id", "at", "t", "2024-01-01", buckets=8)
            merge(rows, 0)
            merge(rows.withColumn("at", F.col("at") + 1), 1)
        finally:
            stream.FILE_ROWS = before
        written = [len(list((tmp_path / name / f"version=00000000{n}").rglob("*.parquet"))) for n in (0, 1)]
        assert all(n <= 8 * 4 if name == "a" else 8 * 4 < n <= 8 * 7 for n in written), written
        found = stream.current_version(spark, f"{tmp_path}/{name}")
        assert found.count() == 3000 and found.where("at <> id * 2 + 1").count() == 0

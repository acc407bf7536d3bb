import pytest
from pyspark.sql import functions as F

from tamarisk.operators import geospatial, gold, monitoring, nutrition, scd


def test_prevalence_suppresses_small_groups(spark):
    rows = [(i, "a", 1, 1) for i in range(9)] + [(i, "b", 1, i % 2) for i in range(10)] + [(1, None, 1, 1)]
    df = spark.createDataFrame(rows, "visit_id int, district string, visit_round int, stunted int")
    out = {r["district"]: r for r in nutrition.prevalence_by_group(df, ["district", "visit_round"]).collect()}
    assert set(out) == {"a", "b"}
    assert (out["a"]["n"], out["a"]["stunting_rate"]) == (9, None)
    assert (out["b"]["n"], out["b"]["stunting_rate"]) == (10, 0.5)


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (3, 10), (0, 0)], "k long, n long")
    low, high = nutrition.wilson(F.col("k"), F.col("n"))
    out = [tuple(r) for r in df.select(low, high).collect()]
    assert out[0][0] == 0.0 and out[1][1] == 1.0 and out[3] == (0.0, 0.0)
    assert out[2][0] <= 0.3 <= out[2][1]


def test_trend_needs_its_column(spark):
    with pytest.raises(ValueError):
        nutrition.prevalence_trend(spark.createDataFrame([(1,)], "visit_round int"), "stunting_rate")


def test_double_burden_counts_missing_as_no(spark):
    df = spark.createDataFrame([(1, "a", 1, None, 1), (2, "a", 1, 1, 1)], "visit_id int, district string, visit_round int, stunted int, wasted int")
    r = nutrition.double_burden(df).collect()[0]
    assert (r["n"], r["stunting_rate"], r["double_burden_rate"]) == (2, 1.0, 0.5)


def test_anomalies_one_row_a_visit(spark):
    rows = [(1, 7, 1, "2024-01-01", "child", 5), (2, 7, 1, "2024-01-01", "child", 30), (3, 8, 1, "2024-01-01", "child", 30)]
    df = spark.createDataFrame(rows, "visit_id int, household_id int, enumerator_id int, visit_date string, record_type string, interview_duration_min int")
    assert {r["visit_id"]: r["anomaly_type"] for r in monitoring.detect_anomalies(df).collect()} == {1: "short_interview", 2: "duplicate_visit"}


def test_anomalies_without_keys(spark):
    rows = [(1, None, 1, None, "child", 30), (2, None, 1, None, "child", 30), (3, 8, 1, None, "child", 30)]
    df = spark.createDataFrame(rows, "visit_id int, household_id int, enumerator_id int, visit_date string, record_type string, interview_duration_min int")
    assert {r["visit_id"]: r["anomaly_type"] for r in monitoring.detect_anomalies(df).collect()} == {1: "duplicate_visit", 2: "duplicate_visit"}


def scd_rows(df):
    return sorted((r["id"], r["x"], r["_scd_version"], r["_scd_is_current"], r["_scd_effective_to"]) for r in df.collect())


def test_scd2_keeps_all_versions(spark):
    kind = "id int, x string"
    old = scd.initial_versions(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], kind))
    once = scd.apply_scd2(old, spark.createDataFrame([(1, "b"), (2, None), (4, "d")], kind), "id", ["x"], "2021")
    assert [r[:4] for r in scd_rows(once.where("id != 2"))] == [(1, "a", 1, False), (1, "b", 2, True), (3, "c", 1, True), (4, "d", 1, True)]
    assert once.where("id = 2").count() == 1
    twice = scd.apply_scd2(once, spark.createDataFrame([(1, "z")], kind), "id", ["x"], "2022")
    assert scd_rows(twice.where("id = 1")) == [(1, "a", 1, False, "2021"), (1, "b", 2, False, "2022"), (1, "z", 3, True, None)]


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, x string, seq int")
    assert sorted(map(tuple, scd.upsert(old, new, "id", "seq").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert tuple(scd.upsert_stats(old, new, "id").first()) == (1, 1, 1)


def test_sequence_is_gapless(spark):
    out = scd.tag_changes(spark.range(100).toDF("id"), "INSERT", "t", "2024-01-01", first_sequence=5)
    assert sorted(r["_cdc_seq"] for r in out.collect()) == list(range(5, 105))


def test_tag_against(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "id int, x string")
    assert {r["id"]: r["_cdc_op"] for r in scd.tag_against(old, new, "id", "t", "2024-01-01").collect()} == {2: "UPDATE", 3: "INSERT"}


def test_rounds_only_where_there_is_none(spark):
    df = spark.createDataFrame([(1, 2020), (2, 2022), (3, None)], "visit_id int, survey_year int")
    assert [r["visit_round"] for r in gold.rounds_and_years(df).orderBy("visit_id").collect()] == [1, 3, 1]
    given = spark.createDataFrame([(1, 4), (2, None)], "visit_id int, visit_round int")
    assert [(r["visit_round"], r["survey_year"]) for r in gold.rounds_and_years(given).orderBy("visit_id").collect()] == [(4, 2022), (1, 2022)]


def test_union_of_eras(spark):
    a, b = spark.createDataFrame([(1,)], "visit_id int"), spark.createDataFrame([(2,)], "record_id int")
    out = {r["data_era"]: (r["visit_id"], r["record_id"]) for r in gold.union_eras(a, b).collect()}
    assert out == {"current": (1, None), "historical": (None, 2)}


def test_nearest_facility_by_grid_equals_broadcast(spark, monkeypatch):
    homes = spark.range(60).selectExpr("id as household_id", "25 + id * 0.11 as gps_latitude", "62 + (id * 7 % 60) * 0.2 as gps_longitude")
    sites = spark.range(15).selectExpr("id as facility_id", "25 + id * 0.5 as gps_latitude", "62 + (id * 11 % 15) * 0.8 as gps_longitude")
    one = {r["household_id"]: (r["nearest_facility"], r["distance_m"]) for r in geospatial.nearest_facility(homes, sites).collect()}
    monkeypatch.setattr(geospatial, "BROADCAST_FACILITIES", 3)
    two = {r["household_id"]: (r["nearest_facility"], r["distance_m"]) for r in geospatial.nearest_facility(homes, sites).collect()}
    assert one == two and len(one) == 60


def test_utm_of_zone_centre(spark):
    p = geospatial.projected(spark.createDataFrame([(0.0, 75.0), (31.5497, 74.3436)], "gps_latitude double, gps_longitude double")).collect()
    assert (round(p[0]["x_m"], 3), round(p[0]["y_m"], 3)) == (500000.0, 0.0)
    assert abs(p[1]["x_m"] - 437700) < 200 and abs(p[1]["y_m"] - 3490700) < 500

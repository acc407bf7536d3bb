"""Operators that search, rank and match in bounded pieces, against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarisk.operators import geospatial, insights, monitoring, scd


@pytest.mark.parametrize("accuracy", [10_000, 50, 10])
def test_exact_quantiles(spark, monkeypatch, accuracy):
    """Coarse sketches too, with ties, tiny groups and brackets that miss their rank."""
    rng = random.Random(accuracy)
    groups = {"ties": [rng.choice([1.0, 2.0, 7.5]) for _ in range(900)], "wide": [rng.gauss(0, 1e3) for _ in range(1500)], "one": [4.0], "two": [1.0, 2.0], "same": [3.0] * 50}
    rows = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k string, x double").repartition(6)
    shares = (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)
    for few in (100_000, 1):
        monkeypatch.setattr(insights, "BROADCAST_GROUPS", few)
        out = {r["k"]: (r["n"], r["q"]) for r in insights.exact_quantiles(rows, "k", "x", shares, accuracy=accuracy).collect()}
        for k, xs in groups.items():
            assert out[k][0] == len(xs) and np.allclose(out[k][1], np.quantile(xs, shares), rtol=1e-12, atol=1e-9), k


def test_missed_brackets_are_counted_in_full(spark, monkeypatch):
    rows = spark.createDataFrame([("a", float(i)) for i in range(101)], "k string, x double")
    monkeypatch.setattr(insights.F, "percentile_approx", lambda *_: F.array(F.lit(90.0), F.lit(95.0)))  # a sketch that is wrong
    assert insights.exact_quantiles(rows, "k", "x", (0.5,)).first()["q"] == [50.0]


@pytest.mark.parametrize("facts_of_key", [1_000_000, 40])
def test_as_of_by_brute_force(spark, facts_of_key):
    """Hot keys in parts, keys without a version, gaps, null keys and times, repeated facts."""
    rng = random.Random(7)
    day = lambda i: f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}"
    versions = []
    for key in range(5):
        starts = sorted(rng.sample(range(300), 1 + key * 20))
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], None], strict=True)):
            end = None if b is None else day(a + 1 if rng.random() < 0.2 else b)
            versions.append((key, f"v{key}.{n}", day(a), end, n + 1))
    facts = [(i, rng.choice([0, 1, 4, 4, 4, 4, 9, None]), rng.choice([day(rng.randrange(300)), None, day(5)])) for i in range(600)]
    facts += facts[:50]
    d = spark.createDataFrame(versions, "id int, name string, _scd_effective_from string, _scd_effective_to string, _scd_version int")
    f = spark.createDataFrame(facts, "fact int, id int, at string")
    out = sorted(((r["fact"], r["id"], r["at"], r["name"]) for r in scd.as_of(f, d, "id", "at", facts_of_key).collect()), key=repr)
    holds = lambda v, key, at: at is not None and v[0] == key and v[2] <= at and (v[3] is None or at < v[3])
    want = sorted(((i, k, at, next((v[1] for v in versions if holds(v, k, at)), None)) for i, k, at in facts), key=repr)
    assert out == want
    plan = scd.as_of(f, d, "id", "at")._jdf.queryExecution().optimizedPlan().toString()
    assert ">=" not in plan.split("Join")[-1] or "Window" in plan


def test_as_of_costs_the_sum_of_facts_and_versions(spark):
    """10,000 versions of one key and many facts: the rows that meet are their sum, and no join pairs them."""
    d = spark.range(10_000).selectExpr("1 as id", "id as name", "lpad(cast(id as string), 6, '0') as _scd_effective_from", "lpad(cast(id + 1 as string), 6, '0') as _scd_effective_to", "cast(id + 1 as int) as _scd_version")
    f = spark.range(200_000).selectExpr("id as fact", "1 as id2", "lpad(cast(id % 10000 as string), 6, '0') as at").withColumnRenamed("id2", "id")
    out = scd.as_of(f, d, "id", "at", 50_000)
    assert out.where("name = fact % 10000").count() == 200_000


def test_nearest_facility_by_brute_force(spark, monkeypatch):
    """Clusters, places that coincide, households far outside; broadcast or not."""
    rng = random.Random(3)
    sites = [(i, 30 + rng.random() * 1e-3, 70 + rng.random() * 1e-3) for i in range(400)] + [(1000 + i, 24 + rng.random() * 8, 62 + rng.random() * 12) for i in range(60)]
    sites += [(2000 + i, 26.5, 66.5) for i in range(40)]
    homes = [(i, 23 + rng.random() * 12, 60 + rng.random() * 16) for i in range(80)] + [(100, 30.0005, 70.0005), (101, 26.5, 66.5), (102, 60.0, 20.0)]
    f = spark.createDataFrame(sites, "facility_id long, gps_latitude double, gps_longitude double")
    h = spark.createDataFrame(homes, "household_id long, gps_latitude double, gps_longitude double")
    at = {name: {r[0]: (r["x_m"], r["y_m"]) for r in geospatial.projected(df).collect()} for name, df in (("f", f), ("h", h))}
    want = {i: min((round(math.dist(p, q), 6), j) for j, q in at["f"].items()) for i, p in at["h"].items()}
    for few in (20_000, 1):
        monkeypatch.setattr(geospatial, "BROADCAST_FACILITIES", few)
        out = {r["household_id"]: r for r in geospatial.nearest_facility(h, f).collect()}
        assert {i: r["nearest_facility"] for i, r in out.items()} == {i: j for i, (_, j) in want.items()}
        assert all(abs(out[i]["distance_m"] - d) <= 0.06 for i, (d, _) in want.items())


def test_far_cluster_is_met_by_its_front(spark):
    """Households far from a dense cluster are compared with few of its 4,000 facilities."""
    rng = random.Random(5)
    places = spark.createDataFrame([(i, 1e6 + rng.random() * 2e4, 3e6 + rng.random() * 2e4) for i in range(4_000)], "f_id long, fx double, fy double")
    cells = spark.createDataFrame([(i, 0, i * 2500.0, 0.0, 2500.0) for i in range(20)], "cx long, cy long, low_x double, low_y double, width double")
    near = geospatial._candidates(cells, places, 1e6, 3e6, 2e4).select(F.size("near").alias("n")).collect()
    assert len(near) == 20 and max(r["n"] for r in near) <= 400


def test_anomalies_of_four_kinds(spark):
    rows = [(i, i, 1, f"2024-01-{1 + i:02d}", "child", 30, z) for i, z in enumerate([0.1, 0.0, -0.1, 0.2, -0.2, 0.05, 3.0, 7.0])]
    rows += [(8, 8, 1, "2024-02-01", "child", 5, 7.0), (9, 9, 1, "2024-02-02", "child", 30, 0.0), (10, 9, 1, "2024-02-02", "child", 30, 9.0), (11, 11, 1, "2024-02-03", "child", 30, 9.0), (12, 12, None, None, None, None, None)]
    visits = spark.createDataFrame(rows, "visit_id int, household_id int, enumerator_id int, visit_date string, record_type string, interview_duration_min int, haz_score double")
    homes = spark.createDataFrame([(i, "A", 30.0 + 5 * (i in (8, 11)), 70.0) for i in range(13)], "household_id int, district string, gps_latitude double, gps_longitude double")
    centres = spark.createDataFrame([("A", 30.0, 70.0)], "district string, centre_lat double, centre_lon double")
    found = {r["visit_id"]: r["anomaly_type"] for r in monitoring.detect_anomalies(visits, households=homes, centres=centres).collect()}
    assert found == {6: "implausible_z", 7: "implausible_z", 8: "short_interview", 9: "duplicate_visit", 10: "duplicate_visit", 11: "far_from_centre"}
    spread = monitoring.score_spread(visits, "haz_score").first()
    zs = [r[6] for r in rows[:-1]]
    assert spread["_median"] == np.median(zs) and math.isclose(spread["_mad"], np.median(np.abs(np.array(zs) - np.median(zs))))

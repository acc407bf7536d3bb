"""Monitoring of field work: enumerators, anomalies, back-checks, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.functions.cleaning import bilingual
from tamarisk.functions.numeric import percent, rounded
from tamarisk.operators.nutrition import known_keys
from tamarisk.sources.shared import cut, small_tasks


def enumerator_summary(perf: DataFrame, keys: tuple[str, ...] = ("enumerator_id", "enumerator_name", "district")) -> DataFrame:
    """Days, submissions and interview length of each enumerator; short means are flagged."""
    keys = [k for k in keys if k in perf.columns]
    out = known_keys(perf, keys).groupBy(*keys).agg(
        F.count_distinct("date").alias("total_days_worked"),
        F.sum("submissions").alias("total_submissions"),
        rounded(F.avg("submissions"), 2).alias("avg_daily_submissions"),
        rounded(F.avg("avg_duration_min"), 2).alias("avg_interview_min"),
        F.count_if(F.col("short_interviews") > 0).alias("short_interview_days"),
        F.sum("flagged_for_backcheck").alias("backcheck_flags"),
    )
    return out.withColumn("quality_flag", F.coalesce(F.col("avg_interview_min") < 15, F.lit(False)))


#: Kinds of anomalies; of those that a visit has the first counts.
ANOMALIES = ("short_interview", "duplicate_visit", "far_from_centre", "implausible_z")
#: A score whose distance from its enumerator's median is so many times their median distance (scaled to a standard deviation) stands out.
Z_DEVIATIONS, MAD_SCALE = 6.0, 1.4826


def score_spread(visits: DataFrame, score: str, key: str = "enumerator_id") -> DataFrame:
    """``key, _median, _mad``: median of each enumerator's scores and median of their distances from it.

    Scores have two decimals, so both medians are read from counts of some hundred values for each enumerator.
    """
    x = F.round(F.col(score).cast("double"), 2)
    counts = cut(visits.select(key, x.alias("x")).where(F.col(key).isNotNull() & F.col("x").isNotNull()).groupBy(key, "x").agg(F.count("*").alias("n")))
    medians = counts.groupBy(key).agg(F.percentile("x", F.lit(0.5), F.col("n")).alias("_median"))
    away = counts.join(medians, key).withColumn("d", F.abs(F.col("x") - F.col("_median")))
    return away.groupBy(key).agg(F.first("_median").alias("_median"), F.percentile("d", F.lit(0.5), F.col("n")).alias("_mad"))


def detect_anomalies(visits: DataFrame, shortest: float = 10, households: DataFrame | None = None, centres: DataFrame | None = None, km: float = 100.0, scores: tuple[str, ...] = ("haz_score",)) -> DataFrame:
    """Short interviews, repeated visits of a household on a day, households far from their district's centre and scores
    that can't be or that stand out among those of their enumerator; one row for each visit id, of the first kind that it has.
    """
    small_tasks(visits.sparkSession)
    far = F.lit(False)
    if households is not None and centres is not None:
        places = far_from_centre(households, centres, km).select(F.col("household_id").alias("_far")).distinct()
        visits = visits.join(places, F.col("household_id") == F.col("_far"), "left")
        far = F.col("_far").isNotNull()
    odd = F.lit(False)
    for score in (c for c in scores if c in visits.columns):
        x = F.round(F.col(score).cast("double"), 2)
        spread = score_spread(visits, score).select(F.col("enumerator_id").alias("_e"), F.col("_median").alias(f"_m_{score}"), F.col("_mad").alias(f"_d_{score}"))
        visits = visits.join(spread, F.col("enumerator_id") == F.col("_e"), "left").drop("_e")
        out = (F.abs(x) > 6) | ((F.col(f"_d_{score}") > 0) & (F.abs(x - F.col(f"_m_{score}")) > Z_DEVIATIONS * MAD_SCALE * F.col(f"_d_{score}")))
        odd = odd | F.coalesce(out, F.lit(False))
    keys = ("household_id", "visit_date", "record_type")  # missing ones are equal to each other
    # Counts are combined before the shuffle, so that no task gathers all rows without keys.
    same = visits.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_same")).where("_same > 1")
    both = visits.join(same, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    kind = F.when(F.col("interview_duration_min") < shortest, ANOMALIES[0]).when(F.col("_same") > 1, ANOMALIES[1]).when(far, ANOMALIES[2]).when(odd, ANOMALIES[3])
    found = both.withColumn("anomaly_type", kind).where("anomaly_type is not null")
    first = F.min_by(
        F.struct("household_id", "enumerator_id", "visit_date", "anomaly_type"),
        F.struct(F.array_position(F.array(*map(F.lit, ANOMALIES)), F.col("anomaly_type")), "household_id", "enumerator_id", "visit_date"),
    )
    return found.groupBy("visit_id").agg(first.alias("r")).select("visit_id", "r.*")


def backcheck_overall(checks: DataFrame) -> DataFrame:
    return checks.agg(
        rounded(F.avg("overall_pass"), 3).alias("overall_pass_rate"),
        rounded(F.avg("height_discrepancy_cm"), 2).alias("mean_height_discrepancy"),
        rounded(F.avg("weight_discrepancy_kg"), 3).alias("mean_weight_discrepancy"),
        rounded(1 - F.avg("morbidity_match"), 3).alias("morbidity_mismatch_rate"),
    )


def backcheck_by_enumerator(checks: DataFrame, key: str = "per_enumerator") -> DataFrame:
    return known_keys(checks, [key]).groupBy(key).agg(
        F.count("*").alias("n_backchecked"),
        rounded(F.avg("overall_pass"), 3).alias("pass_rate"),
        rounded(F.avg("height_discrepancy_cm"), 3).alias("avg_height_disc_cm"),
        rounded(F.avg("weight_discrepancy_kg"), 3).alias("avg_weight_disc_kg"),
    )


def submission_timeline(visits: DataFrame) -> DataFrame:
    """Distinct visits by day and district with the running total of each district."""
    daily = known_keys(visits, ["visit_date", "district"]).groupBy("visit_date", "district").agg(F.count_distinct("visit_id").alias("submissions"))
    window = Window.partitionBy("district").orderBy("visit_date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cumulative", F.sum("submissions").over(window))


def coverage_by_uc(households: DataFrame, visits: DataFrame) -> DataFrame:
    """Enrolled and visited households of each union council."""
    keys = ["district", "union_council"]
    enrolled = known_keys(households, keys).groupBy(*keys).agg(F.count("*").alias("enrolled"))
    seen = known_keys(visits.where(F.col("record_type") == "child"), keys)
    seen = seen.groupBy(*keys).agg(F.count_distinct("household_id").alias("visited"))
    out = enrolled.join(seen, keys, "left").withColumn("visited", F.coalesce("visited", F.lit(0).cast("long")))
    return out.withColumn("coverage_pct", percent(F.col("visited"), F.col("enrolled")))


def grade(rate: Column) -> Column:
    return F.when(rate < 0.70, "FAIL").when(rate < 0.85, "WARN").when(rate.isNotNull(), "PASS")


def enumerator_grades(checks: DataFrame, key: str = "per_enumerator") -> DataFrame:
    out = known_keys(checks, [key]).groupBy(key).agg(rounded(F.avg("overall_pass"), 3).alias("pass_rate"), F.count("*").alias("n"))
    return out.withColumn("grade", grade(F.col("pass_rate")))


def live_quality(households: DataFrame, visits: DataFrame) -> DataFrame:
    """Counts of what is wrong in raw rows: repeated ids, coordinates, heights, bilingual labels."""
    hh = households.agg(
        (F.count("household_id") - F.count_distinct("household_id")).alias("duplicate_households"),
        F.count_if(F.col("gps_latitude").isNotNull() & ~F.col("gps_latitude").between(23.5, 37.5)).alias("bad_gps"),
        F.count_if(bilingual("ses_tier") | bilingual("water_source")).alias("bilingual_values"),
    )
    vis = visits.agg(F.count_if((F.col("record_type") == "child") & ~F.col("height_cm").between(40, 130)).alias("bad_heights"))
    return hh.crossJoin(vis)  # one row each


def backcheck_sample(visits: DataFrame, seed: str = "42", below: str = "199a") -> DataFrame:
    """About a tenth of the child visits, chosen by a seeded digest of the visit id."""
    lot = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("visit_id").cast("string")).cast("binary")), 1, 4)
    return visits.where((F.col("record_type") == "child") & (lot < below))


def reconcile(originals: DataFrame, rechecks: DataFrame) -> DataFrame:
    """Original and second measurement of a visit: differences and whether they pass (2 cm, 0.5 kg, same morbidity)."""
    both = rechecks.join(originals, "visit_id")
    both = both.withColumns({
        "height_discrepancy_cm": F.abs(F.col("height_cm") - F.col("height_recheck_cm")),
        "weight_discrepancy_kg": F.abs(F.col("weight_kg") - F.col("weight_recheck_kg")),
    })
    passed = (F.col("height_discrepancy_cm") <= 2.0) & (F.col("weight_discrepancy_kg") <= 0.5) & (F.col("morbidity_match") == 1)
    return both.withColumn("overall_pass", F.coalesce(passed, F.lit(False)).cast("int"))


def backcheck_timeliness(visits: DataFrame, checks: DataFrame, hours: int = 72) -> DataFrame:
    """Back-checks with the delay after their visit and whether it is within the limit."""
    both = checks.join(visits.select(F.col("visit_id").alias("original_visit_id"), "visit_date").distinct(), "original_visit_id")
    delay = (F.unix_seconds(F.col("backcheck_date").cast("timestamp")) - F.unix_seconds(F.col("visit_date").cast("timestamp"))) / 3600
    return both.withColumn("delay_hours", delay).withColumn("in_time", F.col("delay_hours").between(0, hours))


def far_from_centre(households: DataFrame, centres: DataFrame, km: float = 100.0) -> DataFrame:
    """Households that lie farther than ``km`` from the centre of their district."""
    from tamarisk.functions.geo import km_between

    found = households.join(centres.select("district", "centre_lat", "centre_lon"), "district")
    away = km_between(F.col("gps_latitude"), F.col("gps_longitude"), F.col("centre_lat"), F.col("centre_lon"))
    return found.withColumn("km_from_centre", F.round(away, 1)).where(F.col("km_from_centre") > km)

"""Queries over prevalence, monitoring and insights (AN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarisk.operators import gold, insights, monitoring, nutrition
from tamarisk.plans.registry import query


def r(x: str, n: int) -> str:
    """Rounding as in ``numeric.rounded``."""
    return f"round({x} + 1e-9, {n})"


_RATES = ", ".join(f"CASE WHEN count(visit_id) >= 10 THEN {r(f'avg({c})', 3)} END AS {name}" for name, c in nutrition.INDICATORS.items())


@query("an01_prevalence_by_group", f"SELECT district, visit_round, count(visit_id) AS n, {_RATES} FROM children WHERE district IS NOT NULL AND visit_round IS NOT NULL GROUP BY district, visit_round")
def _(v):
    facts = gold.child_fact(v("visits"), v("households"))
    return nutrition.prevalence_by_group(facts, ["district", "visit_round"])


@query("an02_national_prevalence", "SELECT count(*) AS n, " + ", ".join(f"{r(f'avg({c})', 3)} AS {n}" for n, c in nutrition.INDICATORS.items()) + " FROM children")
def _(v):
    return nutrition.national_prevalence(v("children"))


def _wilson(k: str, n: str, sign: str) -> str:
    z = nutrition.Z_95
    centre = f"({k} / {n} + {z * z!r} / (2e0 * {n})) / (1e0 + {z * z!r} / {n})"
    margin = f"({z!r} * sqrt(({k} / {n}) * (1e0 - {k} / {n}) / {n} + {z * z!r} / (4e0 * {n} * {n}))) / (1e0 + {z * z!r} / {n})"
    bound = f"greatest(0e0, {centre} - {margin})" if sign == "-" else f"least(1e0, {centre} + {margin})"
    return r(bound, 3)


_K, _N = "CAST(sum(stunted) AS DOUBLE)", "CAST(count(stunted) AS DOUBLE)"


@query(
    "an03_prevalence_trend",
    f"SELECT district, visit_round, count(stunted) AS n, {r(f'{_K} / {_N}', 3)} AS rate, {_wilson(_K, _N, '-')} AS ci_lower, {_wilson(_K, _N, '+')} AS ci_upper "
    "FROM children WHERE district IS NOT NULL GROUP BY district, visit_round HAVING count(stunted) >= 10",
)
def _(v):
    return nutrition.prevalence_trend(v("children"), "stunting_rate")


@query(
    "an04_wilson_interval",
    f"SELECT union_council, k, n, {_wilson('CAST(k AS DOUBLE)', 'CAST(n AS DOUBLE)', '-')} AS ci_lower, {_wilson('CAST(k AS DOUBLE)', 'CAST(n AS DOUBLE)', '+')} AS ci_upper "
    "FROM (SELECT union_council, CAST(sum(wasted) AS BIGINT) AS k, count(wasted) AS n FROM children GROUP BY union_council) AS t",
)
def _(v):
    found = v("children").groupBy("union_council").agg(F.sum("wasted").cast("long").alias("k"), F.count("wasted").alias("n"))
    low, high = nutrition.wilson(F.col("k"), F.col("n"))
    return found.select("union_council", "k", "n", low.alias("ci_lower"), high.alias("ci_upper"))


@query("an05_by_ses", f"SELECT ses_tier, visit_round, count(visit_id) AS n, CASE WHEN count(visit_id) >= 10 THEN {r('avg(wasted)', 3)} END AS wasting_rate FROM children GROUP BY ses_tier, visit_round")
def _(v):
    return nutrition.by_ses(v("children"), "wasting_rate")


_AGE = "CASE WHEN child_age_months > -1 AND child_age_months <= 5 THEN '0-5m' WHEN child_age_months <= 11 THEN '6-11m' WHEN child_age_months <= 23 THEN '12-23m' WHEN child_age_months <= 35 THEN '24-35m' WHEN child_age_months <= 59 THEN '36-59m' END"


@query(
    "an06_by_age_and_sex",
    f"SELECT child_age_group, child_sex, count(visit_id) AS n, CASE WHEN count(visit_id) >= 10 THEN {r('avg(stunted)', 3)} END AS stunting_rate "
    f"FROM (SELECT *, {_AGE} AS child_age_group FROM children) AS t WHERE child_age_group IS NOT NULL GROUP BY child_age_group, child_sex",
)
def _(v):
    from tamarisk.functions.cleaning import child_age_group

    return nutrition.by_age_and_sex(v("children").withColumn("child_age_group", child_age_group("child_age_months")), "stunting_rate", all_levels=True)


@query(
    "an07_double_burden",
    f"SELECT district, visit_round, count(visit_id) AS n, {r('avg(stunted)', 3)} AS stunting_rate, {r('avg(wasted)', 3)} AS wasting_rate, "
    f"{r('avg(CASE WHEN stunted = 1 AND wasted = 1 THEN 1 ELSE 0 END)', 3)} AS double_burden_rate FROM children GROUP BY district, visit_round",
)
def _(v):
    return nutrition.double_burden(v("children"))


@query(
    "an08_completeness",
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, {r(f'100 * avg(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)', 1)} AS completeness_pct FROM children" for c in nutrition.FIELDS
    ),
)
def _(v):
    return nutrition.completeness(v("visits"))


@query(
    "an09_enumerator_summary",
    f"""SELECT *, coalesce(avg_interview_min < 15, false) AS quality_flag FROM (
    SELECT enumerator_id, enumerator_name, district, count(DISTINCT date) AS total_days_worked, CAST(sum(submissions) AS BIGINT) AS total_submissions,
      {r('avg(submissions)', 2)} AS avg_daily_submissions, {r('avg(avg_duration_min)', 2)} AS avg_interview_min,
      count(*) FILTER (WHERE short_interviews > 0) AS short_interview_days, CAST(sum(flagged_for_backcheck) AS BIGINT) AS backcheck_flags
    FROM enumerator_performance WHERE enumerator_id IS NOT NULL GROUP BY enumerator_id, enumerator_name, district) AS t""",
)
def _(v):
    return monitoring.enumerator_summary(v("enumerator_performance"))


#: Kilometres from a household to the centre of its district.
KM = "2 * 6371.0 * asin(sqrt(power(sin((radians(gps_latitude) - radians(centre_lat)) / 2), 2) + cos(radians(gps_latitude)) * cos(radians(centre_lat)) * power(sin((radians(gps_longitude) - radians(centre_lon)) / 2), 2)))"


_OUTLIER = f"abs(round(haz_score, 2)) > 6 OR (mad > 0 AND abs(round(haz_score, 2) - median) > {monitoring.Z_DEVIATIONS} * {monitoring.MAD_SCALE} * mad)"


@query(
    "an10_anomalies",
    f"""SELECT visit_id, household_id, enumerator_id, visit_date, ['short_interview', 'duplicate_visit', 'far_from_centre', 'implausible_z'][kind] AS anomaly_type FROM (
    SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY kind, household_id, enumerator_id, visit_date) AS rn FROM (
      SELECT a.*, CASE WHEN interview_duration_min < 10 THEN 1 WHEN same > 1 THEN 2 WHEN away.household_id IS NOT NULL THEN 3 WHEN {_OUTLIER} THEN 4 END AS kind FROM (
        SELECT *, count(*) OVER (PARTITION BY household_id, visit_date, record_type) AS same FROM visits) AS a
        LEFT JOIN (SELECT DISTINCT household_id FROM households h JOIN districts d ON h.district = d.district WHERE round({{KM}}, 1) > 1200) AS away ON a.household_id = away.household_id
        LEFT JOIN spread ON a.enumerator_id = spread.enumerator_id) AS b WHERE kind IS NOT NULL) AS c WHERE rn = 1""".replace("{KM}", KM),
    extra="""middle AS (SELECT enumerator_id, quantile_cont(round(haz_score, 2), 0.5) AS median FROM visits GROUP BY enumerator_id),
    spread AS (SELECT enumerator_id, any_value(median) AS median, quantile_cont(abs(round(haz_score, 2) - median), 0.5) AS mad FROM visits JOIN middle USING (enumerator_id) GROUP BY enumerator_id)""",
)
def _(v):
    return monitoring.detect_anomalies(v("visits"), households=v("households"), centres=v("districts"), km=1200.0)


@query(
    "an11_backcheck_overall",
    f"SELECT {r('avg(overall_pass)', 3)} AS overall_pass_rate, {r('avg(height_discrepancy_cm)', 2)} AS mean_height_discrepancy, "
    f"{r('avg(weight_discrepancy_kg)', 3)} AS mean_weight_discrepancy, {r('1 - avg(morbidity_match)', 3)} AS morbidity_mismatch_rate FROM backcheck",
)
def _(v):
    return monitoring.backcheck_overall(v("backcheck"))


@query(
    "an12_backcheck_by_enumerator",
    f"SELECT per_enumerator, count(*) AS n_backchecked, {r('avg(overall_pass)', 3)} AS pass_rate, {r('avg(height_discrepancy_cm)', 3)} AS avg_height_disc_cm, "
    f"{r('avg(weight_discrepancy_kg)', 3)} AS avg_weight_disc_kg FROM backcheck GROUP BY per_enumerator",
)
def _(v):
    return monitoring.backcheck_by_enumerator(v("backcheck"))


@query(
    "an13_submission_timeline",
    "SELECT visit_date, district, submissions, CAST(sum(submissions) OVER (PARTITION BY district ORDER BY visit_date) AS BIGINT) AS cumulative "
    "FROM (SELECT visit_date, district, count(DISTINCT visit_id) AS submissions FROM visits GROUP BY visit_date, district) AS t",
)
def _(v):
    return monitoring.submission_timeline(v("visits"))


@query(
    "an14_coverage_by_uc",
    f"""SELECT e.district, e.union_council, enrolled, coalesce(visited, 0) AS visited, {r('1e2 * coalesce(visited, 0) / enrolled', 1)} AS coverage_pct
    FROM (SELECT district, union_council, count(*) AS enrolled FROM households GROUP BY district, union_council) AS e
    LEFT JOIN (SELECT district, union_council, count(DISTINCT household_id) AS visited FROM children GROUP BY district, union_council) AS s
    ON e.district = s.district AND e.union_council = s.union_council""",
)
def _(v):
    return monitoring.coverage_by_uc(v("households"), v("visits"))


_G = "g AS (SELECT district, avg(stunted) AS rate, count(*) AS n FROM children GROUP BY district HAVING avg(stunted) IS NOT NULL)"


@query(
    "an15_extremes",
    f"""SELECT w.district AS worst, {r('w.rate', 4)} AS worst_rate, b.district AS best, {r('b.rate', 4)} AS best_rate, {r('o.x', 4)} AS overall_rate,
    {r('100 * (w.rate - o.x)', 1)} AS gap_pp FROM (SELECT * FROM g ORDER BY rate DESC, district DESC LIMIT 1) AS w,
    (SELECT * FROM g ORDER BY rate, district LIMIT 1) AS b, (SELECT avg(stunted) AS x FROM children) AS o""",
    extra=_G,
)
def _(v):
    return insights.extremes(v("children"), "stunted")


@query(
    "an16_ses_gap",
    f"""SELECT {r("avg(stunted) FILTER (WHERE ses_tier = 'low')", 4)} AS low_rate, {r("avg(stunted) FILTER (WHERE ses_tier = 'high')", 4)} AS high_rate,
    {r("100 * (avg(stunted) FILTER (WHERE ses_tier = 'low') - avg(stunted) FILTER (WHERE ses_tier = 'high'))", 1)} AS gap_pp FROM children""",
)
def _(v):
    return insights.ses_gap(v("children"), "stunted")


@query(
    "an17_round_change",
    f"""SELECT {r('a', 4)} AS first_rate, {r('b', 4)} AS last_rate, {r('100 * (b - a)', 1)} AS change_pp,
    CASE WHEN {r('100 * (b - a)', 1)} > 0 THEN 'up' WHEN {r('100 * (b - a)', 1)} < 0 THEN 'down' ELSE 'flat' END AS direction
    FROM (SELECT min_by(rate, visit_round) AS a, max_by(rate, visit_round) AS b FROM (SELECT visit_round, avg(stunted) AS rate FROM children GROUP BY visit_round) AS t) AS u""",
)
def _(v):
    return insights.round_change(v("children"), "stunted")


@query(
    "an18_district_ranking",
    f"""SELECT district, greatest({r('100 * avg(rate)', 1)}, 5e-1) AS rate_pct, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT district, visit_round, avg(stunted) AS rate, count(visit_id) AS n FROM children GROUP BY district, visit_round) AS t GROUP BY district""",
)
def _(v):
    return insights.district_ranking(v("children"), "stunted")


@query("an19_readiness", f"SELECT district, facility_type, {r('avg(readiness_score)', 1)} AS readiness, count(*) AS n FROM facilities GROUP BY district, facility_type")
def _(v):
    return insights.readiness(v("facilities").withColumnRenamed("visit_round", "assessment_round"), ["district", "facility_type"])


@query(
    "an20_stockout_rates",
    " UNION ALL ".join(f"SELECT '{n}' AS commodity, {r(f'100 * avg({c})', 1)} AS stockout_pct FROM facilities" for c, n in (("stockout_ors", "Ors"), ("stockout_zinc", "Zinc"), ("stockout_iron_folate", "Iron Folate"))),
)
def _(v):
    return insights.stockout_rates(v("facilities"))


@query("an21_share_ready", f"SELECT {r('avg(CASE WHEN readiness_score >= 60 THEN 1 ELSE 0 END)', 4)} AS share, count(readiness_score) AS n FROM facilities")
def _(v):
    return insights.share_at_least(v("facilities"), "readiness_score", 60)


@query(
    "an22_enumerator_grades",
    f"SELECT *, CASE WHEN pass_rate < 7e-1 THEN 'FAIL' WHEN pass_rate < 8.5e-1 THEN 'WARN' WHEN pass_rate IS NOT NULL THEN 'PASS' END AS grade "
    f"FROM (SELECT per_enumerator, {r('avg(overall_pass)', 3)} AS pass_rate, count(*) AS n FROM backcheck GROUP BY per_enumerator) AS t",
)
def _(v):
    return monitoring.enumerator_grades(v("backcheck"))


@query(
    "an23_live_quality",
    """SELECT * FROM (SELECT count(household_id) - count(DISTINCT household_id) AS duplicate_households,
      count(*) FILTER (WHERE gps_latitude IS NOT NULL AND NOT gps_latitude BETWEEN 2.35e1 AND 3.75e1) AS bad_gps,
      count(*) FILTER (WHERE coalesce(regexp_matches(ses_tier, 'پائپ|ہینڈ|کنواں|کم|درمیانہ|زیادہ'), false) OR coalesce(regexp_matches(water_source, 'پائپ|ہینڈ|کنواں|کم|درمیانہ|زیادہ'), false)) AS bilingual_values
      FROM raw_households) AS a, (SELECT count(*) FILTER (WHERE record_type = 'child' AND NOT height_cm BETWEEN 40 AND 130) AS bad_heights FROM visits) AS b""",
)
def _(v):
    return monitoring.live_quality(v("raw_households"), v("visits"))


@query("an24_top_groups", f"SELECT union_council, {r('avg(stunted)', 4)} AS rate, count(*) AS n FROM children GROUP BY union_council HAVING avg(stunted) IS NOT NULL ORDER BY rate DESC, union_council LIMIT 20")
def _(v):
    return insights.top_groups(v("children"), "stunted", "union_council", 20)


@query(
    "an25_indicator_table",
    " UNION ALL ".join(f"SELECT province, '{n}' AS indicator, {r(f'avg({c})', 4)} AS rate FROM children GROUP BY province" for n, c in (("stunting_rate", "stunted"), ("wasting_rate", "wasted"), ("anemia_rate", "anemia"))),
)
def _(v):
    return insights.indicator_table(v("children"), {"stunting_rate": "stunted", "wasting_rate": "wasted", "anemia_rate": "anemia"})


@query(
    "an26_distribution",
    f"""SELECT province, count(*) AS n, min(hemoglobin_gdl) AS minimum, round(quantile_cont(hemoglobin_gdl, 0.25), 6) AS q1, round(quantile_cont(hemoglobin_gdl, 0.5), 6) AS median,
    round(quantile_cont(hemoglobin_gdl, 0.75), 6) AS q3, max(hemoglobin_gdl) AS maximum, {r('avg(CASE WHEN hemoglobin_gdl < 11 THEN 1 ELSE 0 END)', 4)} AS share_below FROM mothers GROUP BY province""",
)
def _(v):
    return insights.distribution(v("mothers"), "hemoglobin_gdl", "province", 11)


@query("an27_maternal_rates", f"SELECT district, visit_round, {r('avg(anc_4plus)', 4)} AS rate, count(*) AS n FROM mothers GROUP BY district, visit_round")
def _(v):
    return insights.maternal_rates(v("mothers"), "anc_4plus", ["district", "visit_round"])


@query(
    "an28_national_kpis",
    f"""SELECT * FROM (SELECT count(*) AS children, {r('avg(stunted)', 4)} AS stunting_rate, {r('avg(wasted)', 4)} AS wasting_rate, count(DISTINCT district) AS districts FROM children) AS a,
    (SELECT count(*) AS mothers, {r('avg(anc_4plus)', 4)} AS anc_4plus_rate FROM mothers) AS b, (SELECT count(*) AS facilities, {r('avg(readiness_score)', 1)} AS readiness FROM facilities) AS c""",
)
def _(v):
    return insights.national_kpis(v("children"), v("mothers"), v("facilities"))


@query("an29_cohort", "SELECT visit_id, household_id, district, visit_round, stunted FROM children WHERE province = 'Punjab' AND district = 'Lahore' AND visit_round = 2")
def _(v):
    return insights.cohort(v("children"), province="Punjab", district="Lahore", visit_round=2).select("visit_id", "household_id", "district", "visit_round", "stunted")


@query(
    "an30_as_fractions",
    "SELECT facility_id, CASE WHEN (SELECT max(readiness_score) FROM facilities) > 1.5 THEN readiness_score / 100 ELSE readiness_score END AS readiness_score, "
    "CAST(stockout_ors AS DOUBLE) AS stockout_ors FROM facilities",
)
def _(v):
    return insights.as_fractions(v("facilities").select("facility_id", "readiness_score", "stockout_ors"), ["readiness_score", "stockout_ors"])


@query("an31_levels", "SELECT DISTINCT district FROM households WHERE province = 'Sindh'")
def _(v):
    return insights.levels(v("households"), "district", province="Sindh")


@query(
    "an32_latest",
    "SELECT event_id, household_id, submission_time, (SELECT count(*) FROM submissions) AS total FROM submissions ORDER BY submission_time DESC, event_id LIMIT 10",
)
def _(v):
    return insights.latest(v("submissions").select("event_id", "household_id", "submission_time"), "submission_time", 10, "event_id")


@query("an33_change_counts", "SELECT _cdc_op, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'INSERT' WHEN event_id % 3 = 1 THEN 'UPDATE' END AS _cdc_op FROM events) AS t WHERE _cdc_op IS NOT NULL GROUP BY _cdc_op")
def _(v):
    op = F.when(F.col("event_id") % 3 == 0, "INSERT").when(F.col("event_id") % 3 == 1, "UPDATE")
    return insights.change_counts(v("events").select(op.alias("_cdc_op")))


@query("an34_backcheck_sample", "SELECT visit_id, household_id, visit_date FROM children WHERE substr(md5(concat('42:', CAST(visit_id AS VARCHAR))), 1, 4) < '199a'")
def _(v):
    return monitoring.backcheck_sample(v("visits")).select("visit_id", "household_id", "visit_date")


_RECHECK = "SELECT visit_id, max(height_cm) AS height_cm, max(weight_kg) AS weight_kg FROM children GROUP BY visit_id"


@query(
    "an35_reconcile",
    f"""SELECT visit_id, round(abs(height_cm - height_recheck_cm), 6) AS height_discrepancy_cm, round(abs(weight_kg - weight_recheck_kg), 6) AS weight_discrepancy_kg,
    CASE WHEN abs(height_cm - height_recheck_cm) <= 2 AND abs(weight_kg - weight_recheck_kg) <= 5e-1 AND visit_id % 7 <> 0 THEN 1 ELSE 0 END AS overall_pass
    FROM (SELECT *, height_cm + (visit_id % 9) / 2e0 - 2e0 AS height_recheck_cm, weight_kg + (visit_id % 3) / 4e0 AS weight_recheck_kg FROM ({_RECHECK}) AS o) AS t""",
)
def _(v):
    originals = v("children").groupBy("visit_id").agg(F.max("height_cm").alias("height_cm"), F.max("weight_kg").alias("weight_kg"))
    checks = originals.selectExpr(
        "visit_id", "height_cm + (visit_id % 9) / 2D - 2D as height_recheck_cm", "weight_kg + (visit_id % 3) / 4D as weight_recheck_kg",
        "case when visit_id % 7 <> 0 then 1 else 0 end as morbidity_match",
    )
    out = monitoring.reconcile(originals, checks)
    return out.select("visit_id", F.round("height_discrepancy_cm", 6).alias("height_discrepancy_cm"), F.round("weight_discrepancy_kg", 6).alias("weight_discrepancy_kg"), "overall_pass")


@query(
    "an36_derived_indicators",
    """SELECT stunted, wasted, underweight, severe_stunted, severe_wasted, anemia, muac_class, count(*) AS n FROM (
    SELECT CASE WHEN haz_score < -2 THEN 1 ELSE 0 END AS stunted, CASE WHEN whz_score < -2 THEN 1 ELSE 0 END AS wasted, CASE WHEN waz_score < -2 THEN 1 ELSE 0 END AS underweight,
      CASE WHEN haz_score < -3 THEN 1 ELSE 0 END AS severe_stunted, CASE WHEN whz_score < -3 THEN 1 ELSE 0 END AS severe_wasted, CASE WHEN hemoglobin_gdl < 11 THEN 1 ELSE 0 END AS anemia,
      CASE WHEN muac_mm < 115 THEN 'SAM' WHEN muac_mm < 125 THEN 'MAM' WHEN muac_mm IS NOT NULL THEN 'normal' END AS muac_class FROM children) AS t GROUP BY ALL""",
)
def _(v):
    keys = ["stunted", "wasted", "underweight", "severe_stunted", "severe_wasted", "anemia", "muac_class"]
    return nutrition.derive_indicators(v("children")).groupBy(*keys).agg(F.count("*").alias("n"))


@query(
    "an37_double_burden_bound",
    f"""SELECT district, {r('100 * s', 1)} AS stunting_pct, {r('100 * w', 1)} AS wasting_pct, {r('100 * least(s, w)', 1)} AS double_burden_max_pct FROM (
    SELECT district, avg(a) AS s, avg(b) AS w FROM (SELECT district, visit_round, {r('avg(stunted)', 4)} AS a, {r('avg(wasted)', 4)} AS b FROM children GROUP BY province, district, visit_round) AS t GROUP BY district) AS u""",
)
def _(v):
    return insights.double_burden_bound(gold.district_report(gold.child_fact(v("visits"), v("households")), None))


@query(
    "an38_target_attainment",
    " UNION ALL ".join(f"SELECT province, '{c}' AS indicator, {r(f'avg({c})', 4)} AS rate, CAST({t} AS DOUBLE) AS target, {r(f'avg({c})', 4)} >= {t}e0 AS met FROM visits GROUP BY province" for c, t in insights.TARGETS.items()),
)
def _(v):
    return insights.target_attainment(v("visits"), "province")


@query(
    "an39_backcheck_timeliness",
    """SELECT original_visit_id, delay_hours, delay_hours BETWEEN 0 AND 72 AS in_time FROM (
    SELECT b.original_visit_id, CAST((b.visit_date + CAST(b.original_visit_id % 6 - 1 AS INT)) - d.visit_date AS BIGINT) * 24e0 AS delay_hours
    FROM backcheck b JOIN (SELECT DISTINCT visit_id, visit_date FROM visits) AS d ON b.original_visit_id = d.visit_id) AS t""",
)
def _(v):
    checks = v("backcheck").withColumn("backcheck_date", F.expr("date_add(visit_date, cast(original_visit_id % 6 - 1 as int))")).drop("visit_date")
    return monitoring.backcheck_timeliness(v("visits"), checks).select("original_visit_id", "delay_hours", "in_time")

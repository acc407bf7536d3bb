"""Queries over the cleaning operators (SV): fields, then whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarisk.functions import cleaning as C
from tamarisk.functions import numeric, refdata
from tamarisk.operators import scd, silver
from tamarisk.operators.watch import Watch, table_of
from tamarisk.plans.registry import query
from tamarisk.plans.views import scratch
from tamarisk.sources import files, loads
from tamarisk.sources.shared import small_tasks


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def case(key: str, values: dict[str, str]) -> str:
    return f"CASE {key} {' '.join(f"WHEN '{k}' THEN '{x}'" for k, x in values.items())} END"


def number(c: str) -> str:
    return f"CASE WHEN NOT isnan(try_cast({c} AS DOUBLE)) THEN try_cast({c} AS DOUBLE) END"


def yes_no(c: str, permissive: bool = False) -> str:
    low, x = f"lower({strip(c)})", f"trunc(try_cast(lower({strip(c)}) AS DOUBLE))"
    x = f"CASE WHEN abs({x}) < 9e15 THEN CAST({x} AS BIGINT) END"
    yes, no = refdata.YES + refdata.YES_MORE * permissive, refdata.NO + refdata.NO_MORE * permissive
    other = x if permissive else f"CASE WHEN {x} <> 0 THEN 1 WHEN {x} = 0 THEN 0 END"
    return f"CAST(CASE WHEN {low} IN {yes!r} THEN 1 WHEN {low} IN {no!r} THEN 0 ELSE {other} END AS INT)"


def district(c: str) -> str:
    t, low = strip(c), f"lower({strip(c)})"
    known = case(low, refdata.DISTRICT_VARIANTS | {n.lower(): n for n, *_ in refdata.DISTRICTS})
    part = "CASE " + " ".join(f"WHEN contains('{n.lower()}', {low}) OR contains({low}, '{n.lower()}') THEN '{n}'" for n, *_ in refdata.DISTRICTS) + " END"
    title = rf"array_to_string([upper(x[1]) || x[2:] for x in regexp_extract_all({low}, '\p{{L}}+|[^\p{{L}}]+')], '')"
    return f"CASE WHEN {t} <> '' THEN coalesce({known}, {part}, {title}) END"


def province(c: str) -> str:
    return case(c, refdata.PROVINCE_OF)


def label(c: str, values: dict[str, str]) -> str:
    return f"coalesce({case(f'lower({strip(c)})', values)}, lower({strip(c)}))"


def date(c: str) -> str:
    return f"try_strptime({strip(c)}, ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%d-%m-%Y', '%m-%d-%Y', '%Y/%m/%d', '%d.%m.%Y'])"


def enumerator(c: str) -> str:
    digits = rf"regexp_extract({strip(c)}, '[Ee](?:[Nn][Uu]?)?(\d+)', 1)"
    return f"CASE WHEN {digits} <> '' THEN 'E' || CASE WHEN CAST({digits} AS BIGINT) < 1000 THEN lpad(CAST(CAST({digits} AS BIGINT) AS VARCHAR), 3, '0') ELSE CAST(CAST({digits} AS BIGINT) AS VARCHAR) END ELSE {strip(c)} END"


_INSIDE = "(gps_latitude IS NULL OR (gps_latitude BETWEEN 2.35e1 AND 3.75e1 AND coalesce(gps_longitude BETWEEN 6.05e1 AND 7.75e1, false)))"
LAT, LON = f"CASE WHEN {_INSIDE} THEN gps_latitude END", f"CASE WHEN {_INSIDE} THEN gps_longitude END"
PROVINCE = f"coalesce(province, {province(district('district'))})"
CHILD_AGE = "CASE WHEN {0} > -1 AND {0} <= 5 THEN '0-5m' WHEN {0} > 5 AND {0} <= 11 THEN '6-11m' WHEN {0} > 11 AND {0} <= 23 THEN '12-23m' WHEN {0} > 23 AND {0} <= 35 THEN '24-35m' WHEN {0} > 35 AND {0} <= 59 THEN '36-59m' END"
MOTHER_AGE = "CASE WHEN {0} > 14 AND {0} <= 19 THEN '15-19' WHEN {0} > 19 AND {0} <= 24 THEN '20-24' WHEN {0} > 24 AND {0} <= 29 THEN '25-29' WHEN {0} > 29 AND {0} <= 34 THEN '30-34' WHEN {0} > 34 AND {0} <= 49 THEN '35-49' END"


def field(name: str, sql: str, spark, source: str = "raw_households", key: str = "household_id") -> None:
    """A query that shows one cleaned field beside its key."""

    @query(name, f"SELECT {key}, {sql} AS cleaned FROM {source}")
    def _(v):
        return v(source).select(key, spark().alias("cleaned"))


field("sv03_yes_no", yes_no("has_toilet"), lambda: C.yes_no("has_toilet"))
field("sv04_yes_no_permissive", yes_no("consent_given", True), lambda: C.yes_no("consent_given", permissive=True))
field("sv05_district", district("district"), lambda: C.district("district"))
field("sv06_water_source", label("water_source", refdata.WATER_URDU), lambda: C.water_source("water_source"))
field("sv07_ses_tier", label("ses_tier", refdata.SES_URDU), lambda: C.ses_tier("ses_tier"))
field("sv08_legacy_ses", label("ses_tier", refdata.SES_LEGACY), lambda: C.legacy_ses_tier("ses_tier"))
field("sv08_legacy_water", label("water_source", refdata.WATER_LEGACY), lambda: C.legacy_water_source("water_source"))
field("sv09_parse_date", f"CAST({date('enrollment_date')} AS DATE)", lambda: F.to_date(C.parse_date("enrollment_date")))
field("sv10_enumerator_id", enumerator("enumerator_id"), lambda: C.enumerator_id("enumerator_id"))
field("sv11_null_outside", f"CASE WHEN {number('respondent_age')} BETWEEN 15 AND 65 THEN {number('respondent_age')} END", lambda: numeric.null_outside(numeric.to_double("respondent_age"), 15, 65))
field("sv12_clamped", "CASE WHEN muac_mm IS NOT NULL THEN least(greatest(muac_mm, 1e1), 1e2) END", lambda: numeric.clamped("muac_mm", 10.0, 100.0))
field("sv13_to_double", number("respondent_age"), lambda: numeric.to_double("respondent_age"))
field("sv15_gps_latitude", "CASE WHEN gps_latitude BETWEEN 2.35e1 AND 3.75e1 THEN gps_latitude END", lambda: C.gps_latitude("gps_latitude"))
field("sv17_muac_mm", "CASE WHEN muac_mm < 30 THEN muac_mm * 10 ELSE muac_mm END", lambda: C.muac_mm("muac_mm"))
field("sv18_child_age_group", CHILD_AGE.format("(household_id % 70 - 3)"), lambda: C.child_age_group(F.expr("household_id % 70 - 3")))
field("sv19_maternal_age_group", MOTHER_AGE.format("(household_id % 60)"), lambda: C.maternal_age_group(F.expr("household_id % 60")))
field("sv31_changed", f"coalesce(district, '') <> coalesce({district('district')}, '')", lambda: C.changed("district", C.district("district")))


@query("sv01_headers", "SELECT household_id, district AS district_name, gps_latitude FROM households")
def _(v):
    return silver.normal_headers(v.sql("SELECT household_id AS ` Household_ID `, district AS `District Name`, gps_latitude AS `GPS.Latitude` FROM households"), dots=True)


@query("sv02_rename_legacy", "SELECT household_id, district, union_council, coalesce(ses_tier, 'x') AS ses_tier, gps_latitude FROM households")
def _(v):
    raw = v.sql(
        "SELECT household_id AS hh_id, district AS `location.district`, union_council AS tehsil, CASE WHEN household_id % 2 = 0 THEN ses_tier END AS ses, "
        "ses_tier AS `socioeconomic.tier`, gps_latitude AS gps_lat FROM households"
    )
    return silver.rename_legacy(raw)


@query("sv11_null_counts", f"SELECT count(*) FILTER (WHERE {number('respondent_age')} IS NOT NULL AND NOT {number('respondent_age')} BETWEEN 15 AND 65) AS n_nulled FROM raw_households")
def _(v):
    age = numeric.to_double("respondent_age")
    return v("raw_households").agg(F.count_if(age.isNotNull() & numeric.null_outside(age, 15, 65).isNull()).alias("n_nulled"))


@query("sv14_gps_pair", f"SELECT household_id, {LAT} AS gps_latitude, {LON} AS gps_longitude FROM raw_households")
def _(v):
    return silver.gps_bounds(v("raw_households").select("household_id", "gps_latitude", "gps_longitude"))


@query("sv16_fill_province", f"SELECT household_id, coalesce(province, {province('district')}) AS province FROM (SELECT household_id, province, {district('district')} AS district FROM raw_households) AS t")
def _(v):
    return silver.fill_province(v("raw_households").withColumn("district", C.district("district"))).select("household_id", "province")


@query("sv20_drop_missing_keys", "SELECT household_id, district, province FROM raw_households WHERE district IS NOT NULL AND province IS NOT NULL")
def _(v):
    return v("raw_households").na.drop(subset=["district", "province"]).select("household_id", "district", "province")


_ORDER = "visit_date{0} NULLS LAST, l_partkey, enumerator_id, l_extendedprice, household_id"
_COLS = "visit_id, household_id, visit_date, enumerator_id, l_partkey"


def _dedup(way: str) -> str:
    return f"SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY {_ORDER.format(way)}) AS rn FROM visits) AS t WHERE rn = 1"


def _deduped(v, first):
    df = v("visits").select("visit_id", "household_id", "visit_date", "enumerator_id", "l_partkey", "l_extendedprice")
    return scd.first_by_key(df, "visit_id", first, "l_partkey", "enumerator_id", "l_extendedprice", "household_id").drop("l_extendedprice")


@query("sv21_keep_latest", _dedup(" DESC"))
def _(v):
    return _deduped(v, F.col("visit_date").desc_nulls_last())


@query("sv22_keep_first", _dedup(""))
def _(v):
    return _deduped(v, F.col("visit_date").asc_nulls_last())


@query("sv23_keep_last", "SELECT household_id, max(visit_date) AS last_visit FROM visits GROUP BY household_id")
def _(v):
    df = v("visits").select("household_id", "visit_date", "l_partkey")
    return scd.latest_by_key(df, "household_id", "visit_date").select("household_id", F.col("visit_date").alias("last_visit"))


@query("sv24_consent", f"SELECT household_id, {yes_no('consent_given')} AS consent_given FROM raw_households WHERE {yes_no('consent_given')} = 1")
def _(v):
    return silver.consented(v("raw_households").select("household_id", C.yes_no("consent_given").alias("consent_given")))


_CHILD = ", ".join(f"CASE WHEN record_type <> 'child' OR {c} BETWEEN {a} AND {b} THEN {c} END AS {c}" for c, (a, b) in silver.CHILD_LIMITS.items())


@query("sv25_child_limits", f"SELECT visit_id, record_type, {_CHILD} FROM visits")
def _(v):
    return silver.child_limits(v("visits").select("visit_id", "record_type", "height_cm", "weight_kg", "muac_mm"))


@query("sv26_z_limits", "SELECT visit_id, " + ", ".join(f"CASE WHEN abs({c}) <= 6 THEN {c} END AS {c}" for c in ("haz_score", "waz_score", "whz_score")) + " FROM visits")
def _(v):
    return silver.z_limits(v("visits").select("visit_id", "haz_score", "waz_score", "whz_score"))


@query(
    "sv27_maternal_limits",
    "SELECT visit_id, record_type, CASE WHEN record_type <> 'maternal' OR maternal_age BETWEEN 10 AND 60 THEN maternal_age END AS maternal_age, "
    "CASE WHEN hemoglobin_gdl BETWEEN 3 AND 20 THEN hemoglobin_gdl END AS hemoglobin_gdl FROM visits",
)
def _(v):
    return silver.maternal_limits(v("visits").select("visit_id", "record_type", "maternal_age", "hemoglobin_gdl"))


@query("sv28_prefix_flags", "SELECT facility_id, stockout_ors, stockout_zinc FROM facilities")
def _(v):
    raw = v.sql("SELECT facility_id, CASE stockout_ors WHEN 1 THEN 'Yes' ELSE 'no' END AS stockout_ors, CASE stockout_zinc WHEN 1 THEN 'TRUE' ELSE '0' END AS stockout_zinc FROM facilities")
    return silver.apply(raw, dict.fromkeys([c for c in raw.columns if c.startswith("stockout_")], C.yes_no))


@query("sv29_dates_by_name", f"SELECT household_id, CAST({date('enrollment_date')} AS DATE) AS enrollment_date, CAST(NULL AS DATE) AS some_time FROM raw_households")
def _(v):
    raw = v("raw_households").select("household_id", "enrollment_date", F.lit("never").alias("some_time"))
    out = silver.clean_generic(raw)
    return out.select("household_id", F.to_date("enrollment_date").alias("enrollment_date"), F.to_date("some_time").alias("some_time"))


_CHANGED = "coalesce({0}, '') <> coalesce({1}, '')"
_VISIT_RAW = """SELECT CASE WHEN l_partkey % 17 > 0 THEN visit_id END AS visit_id, household_id, record_type, upper(district) AS district, CASE anemia WHEN 1 THEN 'Yes' WHEN 0 THEN 'no' END AS anemia, fever_2w,
  CASE WHEN l_partkey % 23 = 0 THEN 'unknown' ELSE CAST(visit_date AS STRING) END AS visit_date, CAST(height_cm AS STRING) AS height_cm, haz_score, maternal_age, hemoglobin_gdl,
  concat('enu', CAST(enumerator_id AS STRING)) AS enumerator_id, l_extendedprice FROM visits"""
_PLACE_RAW = "SELECT facility_id AS assessment_id, upper(district) AS district, readiness_score * 1.2e0 AS readiness_score, CASE WHEN facility_id % 7 = 0 THEN 'soon' ELSE '2024-01-05' END AS assessment_date FROM facilities"
_LOG_RAW = "SELECT concat('enu', CAST(enumerator_id AS STRING)) AS enumerator_id, CASE WHEN enumerator_id % 9 = 0 THEN 'never' ELSE CAST(date AS STRING) END AS date, avg_duration_min * 20 AS avg_duration_min FROM enumerator_performance"
_CHECK_RAW = "SELECT original_visit_id AS backcheck_id, concat('enu', CAST(max(per_enumerator) AS STRING)) AS backcheck_enumerator_id FROM backcheck GROUP BY original_visit_id"
#: Dataset: rows that its job keeps, and the condition of each issue; counts of rows that go are over a table of their own.
_ISSUES = {
    "households": ("raw_households", {
        "district_normalised": _CHANGED.format("district", district("district")), "water_source_normalised": _CHANGED.format("water_source", label("water_source", refdata.WATER_URDU)),
        "ses_tier_normalised": _CHANGED.format("ses_tier", label("ses_tier", refdata.SES_URDU)),
        "bad_enrollment_dates": f"{date('enrollment_date')} IS NULL", "implausible_respondent_age": f"NOT {number('respondent_age').join('()')} BETWEEN 15 AND 65",
        "implausible_hh_size": f"NOT {number('household_size').join('()')} BETWEEN 1 AND 25", "gps_out_of_bounds_nulled": f"gps_latitude IS NOT NULL AND NOT {_INSIDE}",
        "enum_id_standardised": _CHANGED.format("enumerator_id", enumerator("enumerator_id")), "no_consent_dropped": f"{yes_no('consent_given')} IS DISTINCT FROM 1",
    }),
    "households ": ("raw_households", {"missing_hh_id_dropped": "household_id IS NULL", "duplicates_removed": "TRUE"}),  # every household was sent twice
    "followup_visits": (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY l_extendedprice) AS nth FROM ({_VISIT_RAW}) AS r WHERE visit_id IS NOT NULL) AS q WHERE nth = 1) AS t", {
        "district_normalised": _CHANGED.format("district", district("district")), "bad_visit_dates": "visit_date = 'unknown'", "anemia_converted": "anemia IS NOT NULL", "fever_2w_converted": "FALSE",
        "enum_id_standardised": _CHANGED.format("enumerator_id", enumerator("enumerator_id")), "implausible_height_cm": "record_type = 'child' AND NOT CAST(height_cm AS DOUBLE) BETWEEN 40 AND 130",
        "implausible_haz_score": "abs(haz_score) > 6", "implausible_maternal_age": "record_type = 'maternal' AND NOT maternal_age BETWEEN 10 AND 60", "implausible_hemoglobin": "NOT hemoglobin_gdl BETWEEN 3 AND 20",
    }),
    "followup_visits ": (f"(SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY l_extendedprice) AS nth FROM ({_VISIT_RAW}) AS r) AS t", {"missing_pk_dropped": "visit_id IS NULL", "duplicate_visit_ids": "visit_id IS NOT NULL AND nth > 1"}),
    "facility_assessments": (f"({_PLACE_RAW}) AS t", {"duplicates_dropped": "TRUE", "bad_assessment_dates": "assessment_date = 'soon'", "district_normalised": _CHANGED.format("district", district("district")), "readiness_score_clamped": "readiness_score > 100"}),
    "enumerator_performance": (f"({_LOG_RAW}) AS t", {"bad_dates": "date = 'never'", "enum_id_standardised": "TRUE", "implausible_avg_duration_min": "NOT avg_duration_min BETWEEN 0 AND 480"}),
    "backcheck_records": (f"({_CHECK_RAW}) AS t", {"duplicates_dropped": "TRUE", "enum_id_standardised": "TRUE"}),
}


@query("sv30_quality_issues", " UNION ALL ".join(f"SELECT '{name.strip()}' AS dataset, '{k}' AS issue, count(*) FILTER (WHERE {x}) AS n FROM {rows}" for name, (rows, issues) in _ISSUES.items() for k, x in issues.items()))
def _(v):
    """Counts of all five jobs, each taken while the clean rows are written."""
    hh = v("raw_households")
    raw = {
        "households": hh.withColumn("submission_time", F.lit("2024-01-01")).union(hh.withColumn("submission_time", F.lit("2024-01-02"))),
        "followup_visits": v.sql(_VISIT_RAW).withColumn("_input_order", F.struct("l_extendedprice")),
        "facility_assessments": v.sql(f"{_PLACE_RAW} UNION ALL {_PLACE_RAW}"),
        "enumerator_performance": v.sql(_LOG_RAW),
        "backcheck_records": v.sql(f"{_CHECK_RAW} UNION ALL {_CHECK_RAW}"),
    }
    fixes = []
    for name, df in raw.items():
        watch, path = Watch(), f"{scratch(v)}/{name}"
        files.write(silver.clean(name, df, watch), path)
        fixes += [(name, issue, n) for issue, n in watch.counts(v.spark.read.parquet(path).count()).items()]
    return table_of(v.spark, fixes)


_N = "(SELECT count(*) FROM households)"


@query("sv32_tag_changes", f"SELECT household_id, 'INSERT' AS _cdc_op, 'households' AS _cdc_source, 100 AS first_seq, {_N} + 99 AS last_seq, {_N} AS n_seq FROM households")
def _(v):
    """The sequence is gapless but in an order of its own: its ends and the number of its values are shown."""
    out = scd.tag_changes(v("households").select("household_id", "district"), "INSERT", "households", "2024-01-01", first_sequence=100)
    seq = out.agg(F.min("_cdc_seq").alias("first_seq"), F.max("_cdc_seq").alias("last_seq"), F.count_distinct("_cdc_seq").alias("n_seq"))
    return out.select("household_id", "_cdc_op", "_cdc_source").crossJoin(F.broadcast(seq))  # one row


_HH = f"""SELECT household_id, {district('district')} AS district, {PROVINCE} AS province, {yes_no('has_toilet')} AS has_toilet, {yes_no('consent_given')} AS consent_given,
  {label('ses_tier', refdata.SES_URDU)} AS ses_tier, {label('water_source', refdata.WATER_URDU)} AS water_source, CAST({date('enrollment_date')} AS DATE) AS enrollment_date,
  {enumerator('enumerator_id')} AS enumerator_id, CASE WHEN {number('respondent_age')} BETWEEN 15 AND 65 THEN {number('respondent_age')} END AS respondent_age,
  CASE WHEN {number('household_size')} BETWEEN 1 AND 25 THEN {number('household_size')} END AS household_size, {LAT} AS gps_latitude, {LON} AS gps_longitude
  FROM raw_households"""
HOUSEHOLD_COLUMNS = ("household_id", "district", "province", "has_toilet", "consent_given", "ses_tier", "water_source", "enumerator_id", "respondent_age", "household_size", "gps_latitude", "gps_longitude")


HOUSEHOLD_ROWS = f"SELECT * FROM ({_HH}) AS t WHERE consent_given = 1"


@query("sv33_clean_households", HOUSEHOLD_ROWS)
def _(v):
    out = silver.clean_households(v("raw_households"))
    return out.select(*HOUSEHOLD_COLUMNS, F.to_date("enrollment_date").alias("enrollment_date"))


_V = "visit_id * 1000 + CAST(l_partkey % 1000 AS INT)"
_VISITS = f"""SELECT visit_id, district, record_type, CASE WHEN record_type <> 'child' OR height_cm BETWEEN 40 AND 130 THEN height_cm END AS height_cm,
  CASE WHEN abs(haz_score) <= 6 THEN haz_score END AS haz_score, anemia, {CHILD_AGE.format('child_age_months')} AS child_age_group,
  {MOTHER_AGE.format("(CASE WHEN record_type <> 'maternal' OR maternal_age BETWEEN 10 AND 60 THEN maternal_age END)")} AS maternal_age_group FROM one"""
VISITS_ONCE = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY l_extendedprice) AS nth FROM visits) AS t WHERE nth = 1)"
VISIT_ROWS = _VISITS
VISIT_COLUMNS = ("visit_id", "district", "record_type", "height_cm", "haz_score", "anemia", "child_age_group", "maternal_age_group")


@query("sv34_clean_visits", _VISITS, extra=VISITS_ONCE)
def _(v):
    """Visits come several times; the first to be ingested (here: in the order of a price) counts."""
    raw = v("visits").withColumns({
        "anemia": F.when(F.col("anemia") == 1, "Yes").when(F.col("anemia") == 0, "نہیں"), "height_cm": F.col("height_cm").cast("string"), "district": F.upper("district"),
        "_ingested_at": F.timestamp_micros(F.round(F.col("l_extendedprice") * 1000).cast("long")),
    })
    return silver.clean_visits(raw).select(*VISIT_COLUMNS)


@query("sv35_clean_facilities", "SELECT facility_id AS assessment_id, district, least(readiness_score, 1e2) AS readiness_score, stockout_ors FROM facilities")
def _(v):
    raw = v.sql("SELECT facility_id AS assessment_id, lower(district) AS district, CAST(readiness_score AS STRING) AS readiness_score, CASE stockout_ors WHEN 1 THEN 'yes' ELSE 'no' END AS stockout_ors FROM facilities")
    return silver.clean_facilities(raw.union(raw))


@query("sv36_clean_enumerator_log", "SELECT printf('E%03d', enumerator_id) AS enumerator_id, CAST(date AS DATE) AS day, CAST(submissions AS DOUBLE) AS submissions, CASE WHEN avg_duration_min BETWEEN 0 AND 480 THEN avg_duration_min END AS avg_duration_min FROM enumerator_performance")
def _(v):
    raw = v.sql("SELECT concat('enu', CAST(enumerator_id AS STRING)) AS enumerator_id, CAST(date AS STRING) AS date, CAST(submissions AS STRING) AS submissions, avg_duration_min FROM enumerator_performance")
    out = silver.clean_enumerator_log(raw)
    return out.select("enumerator_id", F.to_date("date").alias("day"), "submissions", "avg_duration_min")


@query("sv37_clean_backchecks", "SELECT DISTINCT original_visit_id AS backcheck_id, max(overall_pass) OVER (PARTITION BY original_visit_id) AS overall_pass FROM backcheck")
def _(v):
    raw = v.sql("SELECT original_visit_id AS backcheck_id, CASE max(overall_pass) WHEN 1 THEN 'Y' ELSE 'N' END AS overall_pass FROM backcheck GROUP BY original_visit_id")
    return silver.clean_backchecks(raw.union(raw))


@query(
    "sv38_clean_generic",
    f"""SELECT household_id, {district('district')} AS district, coalesce(province, {province(district('district'))}) AS province, {yes_no('has_toilet', True)} AS has_toilet,
    {label('ses_tier', refdata.SES_LEGACY)} AS ses_tier, {label('water_source', refdata.WATER_LEGACY)} AS water_source, CASE WHEN muac_mm < 30 THEN muac_mm * 10 ELSE muac_mm END AS muac_mm,
    CASE WHEN gps_latitude BETWEEN 2.35e1 AND 3.75e1 THEN gps_latitude END AS gps_latitude FROM raw_households""",
)
def _(v):
    raw = v.sql("SELECT household_id AS `Household_ID`, district AS district_name, province AS `location.province`, has_toilet AS latrine, ses_tier AS ses, water_source AS water, muac_mm AS muac_cm, gps_latitude AS gps_lat FROM raw_households")
    return silver.clean_generic(raw)


@query(
    "sv39_silver_build",
    f"""SELECT household_id, op AS _cdc_op, CASE WHEN op <> 'DELETE' THEN household_size END AS household_size FROM (
      SELECT *, CASE WHEN household_id % 5 = 1 AND household_id % 7 <> 3 THEN 'INSERT' WHEN household_id % 5 <> 1 AND household_id % 7 = 3 THEN 'DELETE'
        WHEN household_id % 5 <> 1 AND household_id % 7 <> 3 AND household_id % 11 = 2 AND household_size IS NOT NULL THEN 'UPDATE' END AS op FROM ({_HH}) AS h WHERE consent_given = 1) AS t
    WHERE op IS NOT NULL""",
)
def _(v):
    """Second load: a fifth of the households is new, a seventh is gone, an eleventh has another size."""
    raw = v("raw_households")
    first = raw.where("household_id % 5 <> 1").withColumn("household_size", F.when(F.col("household_id") % 11 == 2, F.lit(None)).otherwise(F.col("household_size")))
    before = silver.build({"households": first}, "2024-01-01")
    after = silver.build({"households": raw.where("household_id % 7 <> 3")}, "2024-01-02", before)["households"]
    found = silver.changes(before["households"], after)
    same = F.col("found._cdc_op").eqNullSafe(F.col("after._cdc_op")) | (F.col("found._cdc_op") == "DELETE")
    both = found.alias("found").join(after.alias("after"), F.col("key") == F.col("after.household_id").cast("string"), "left").where(same)
    return both.select(F.col("key").cast("long").alias("household_id"), "found._cdc_op", "after.household_size")


@query("sv39_keyless_reload", "SELECT enumerator_id, CAST(sum(submissions) AS DOUBLE) AS submissions FROM (SELECT printf('E%03d', enumerator_id) AS enumerator_id, submissions FROM enumerator_performance) AS t GROUP BY enumerator_id")
def _(v):
    """A log without a key that was loaded twice, the second time with all its days: each counts once."""
    raw = v.sql("SELECT concat('enu', CAST(enumerator_id AS STRING)) AS enumerator_id, date, submissions, 'log.csv' AS _source_file FROM enumerator_performance")
    loaded = lambda df, at: df.withColumn("_ingested_at", F.lit(at).cast("timestamp"))
    both = loaded(raw.where("date < date'2024-01-20'"), "2024-01-20").union(loaded(raw, "2024-02-01"))
    return silver.build({"enumerator_performance": both}, "2024-02-01")["enumerator_performance"].groupBy("enumerator_id").agg(F.sum("submissions").alias("submissions"))


@query("sv22_input_order", "SELECT o_orderkey, l_linenumber FROM (SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey) AS t WHERE n = 1")
def _(v):
    """The first row of each order in the files, which were written in the order of the lines."""
    small_tasks(v.spark)
    path, rows = f"{scratch(v)}/lines", v.sql("SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
    files.write(rows.repartitionByRange("l_linenumber", "o_orderkey").sortWithinPartitions("l_linenumber"), path, "csv")
    return scd.first_by_key(loads.input_order(files.read(v.spark, path, "csv")), "o_orderkey").selectExpr("cast(o_orderkey as long) as o_orderkey", "cast(l_linenumber as int) as l_linenumber")

"""Queries over dimensions, facts, reports and merges (GD)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.operators import gold, scd, silver
from tamarisk.operators.watch import Watch, table_of
from tamarisk.plans.analytics_queries import r
from tamarisk.plans.cleaning_queries import _ISSUES, yes_no
from tamarisk.plans.registry import query
from tamarisk.plans.views import scratch
from tamarisk.sources import files


def rates(names: dict[str, str]) -> str:
    return ", ".join(f"{r(f'avg({c})', 4)} AS {n}" for n, c in names.items())


def _facts(v) -> tuple[DataFrame, DataFrame]:
    return gold.child_fact(v("visits"), v("households")), gold.maternal_fact(v("visits"), v("households"))


_SCD = "'2020-01-01' AS _scd_effective_from, CAST(NULL AS VARCHAR) AS _scd_effective_to, true AS _scd_is_current, 1 AS _scd_version, 'gold' AS _layer"


@query("gd01_dim_district", f"SELECT d.*, f.n_households FROM (SELECT printf('D%03d', rank) AS district_sk, district AS district_nk, district AS district_name, province, is_urban, centre_lat, centre_lon, {_SCD} FROM districts) AS d LEFT JOIN (SELECT district, count(*) AS n_households FROM households GROUP BY district) AS f ON d.district_nk = f.district")
def _(v):
    n = v("households").groupBy(F.col("district").alias("district_nk")).agg(F.count("*").alias("n_households"))
    return gold.dim_district(v.spark).join(n, "district_nk", "left")


@query("gd02_dim_facility", f"SELECT facility_id AS facility_sk, facility_id AS facility_nk, facility_name, facility_type, district, province, gps_latitude, gps_longitude, {_SCD} FROM facilities")
def _(v):
    return gold.dim_facility(v("facilities"))


# A dimension of customers: keys divisible by 5 are new, by 3 changed, by 7 absent; key 2 modulo 4 had an earlier version.
_EXISTING = """SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation, CASE WHEN c_custkey % 4 = 2 THEN '2021-01-01' ELSE '2020-01-01' END AS _scd_effective_from,
  CAST(NULL AS STRING) AS _scd_effective_to, true AS _scd_is_current, CASE WHEN c_custkey % 4 = 2 THEN 2 ELSE 1 END AS _scd_version FROM customer WHERE c_custkey % 5 <> 0
  UNION ALL SELECT c_custkey, 'OLD', c_nationkey, '2020-01-01', '2021-01-01', false, 1 FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 4 = 2"""
_INCOMING = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer WHERE c_custkey % 7 <> 0"


@query(
    "gd03_scd2",
    f"""WITH e AS ({_EXISTING}), i AS ({_INCOMING}) SELECT * FROM (
    SELECT e.id, e.segment, e.nation, e._scd_effective_from, CASE WHEN e._scd_is_current AND i.id IS NOT NULL AND e.segment IS DISTINCT FROM i.segment THEN '2024-06-01' ELSE e._scd_effective_to END AS _scd_effective_to,
      e._scd_is_current AND NOT (i.id IS NOT NULL AND e.segment IS DISTINCT FROM i.segment) AS _scd_is_current, e._scd_version FROM e LEFT JOIN i ON e.id = i.id
    UNION ALL SELECT i.id, i.segment, i.nation, '2024-06-01', NULL, true, CAST(coalesce(e._scd_version, 0) + 1 AS INT) FROM i LEFT JOIN e ON e.id = i.id AND e._scd_is_current
      WHERE e.id IS NULL OR e.segment IS DISTINCT FROM i.segment) AS t""",
)
def _(v):
    return scd.apply_scd2(v.sql(_EXISTING), v.sql(_INCOMING), "id", ["segment"], "2024-06-01")


_OLD = "SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_custkey % 5 <> 0"
_NEW = "SELECT c_custkey AS id, 'NEW' AS segment, c_acctbal + 1e0 AS balance, c_custkey AS seq FROM customer WHERE c_custkey % 3 = 0"


@query("gd04_upsert", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, segment, balance FROM n")
def _(v):
    new = v.sql(_NEW)
    doubled = new.union(new.withColumns({"segment": F.lit("EARLIER"), "seq": F.col("seq") - 1}))
    return scd.upsert(v.sql(_OLD), doubled, "id", "seq")


@query("gd04_upsert_stats", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT count(*) FILTER (WHERE o.id IS NULL) AS inserts, count(*) FILTER (WHERE o.id IS NOT NULL AND n.id IS NOT NULL) AS updates, count(*) FILTER (WHERE n.id IS NULL) AS unchanged FROM o FULL JOIN n ON o.id = n.id")
def _(v):
    return scd.upsert_stats(v.sql(_OLD), v.sql(_NEW), "id")


@query("gd05_child_fact", "SELECT visit_id, c.household_id, 'current' AS data_era, visit_round, survey_year, visit_date, c.province, c.district, urban_rural, stunted, wasted FROM children c LEFT JOIN households h ON c.household_id = h.household_id")
def _(v):
    return _facts(v)[0].select("visit_id", "household_id", "data_era", "visit_round", "survey_year", "visit_date", "province", "district", "urban_rural", "stunted", "wasted")


@query("gd06_maternal_fact", "SELECT visit_id, c.household_id, 'current' AS data_era, visit_round, survey_year, c.district, urban_rural, maternal_age, anc_4plus, anemia, hemoglobin_gdl FROM mothers c LEFT JOIN households h ON c.household_id = h.household_id")
def _(v):
    return _facts(v)[1].select("visit_id", "household_id", "data_era", "visit_round", "survey_year", "district", "urban_rural", "maternal_age", "anc_4plus", "anemia", "hemoglobin_gdl")


@query("gd07_union_eras", "SELECT visit_id, NULL::BIGINT AS record_id, district, stunted, 'current' AS data_era FROM children WHERE survey_year >= 1998 UNION ALL SELECT NULL AS visit_id, visit_id AS record_id, district, stunted, 'historical' AS data_era FROM children WHERE survey_year < 1998")
def _(v):
    rows = v("children").select("visit_id", "district", "stunted", "survey_year")
    now, then = rows.where("survey_year >= 1998").drop("survey_year"), rows.where("survey_year < 1998").drop("survey_year").withColumnRenamed("visit_id", "record_id")
    return gold.union_eras(now, then)


@query("gd08_rounds_and_years", "SELECT visit_id, CAST(greatest(survey_year - (SELECT min(survey_year) FROM children) + 1, 1) AS INT) AS visit_round, survey_year FROM children")
def _(v):
    return gold.rounds_and_years(v("children").select("visit_id", "survey_year"))


@query("gd09_keep_columns", "SELECT visit_id, visit_round, district, stunted FROM children")
def _(v):
    return gold.keep(v("children"), ["visit_id", "record_id", "visit_round", "district", "no_such_column", "stunted"])


@query("gd10_numeric_columns", "SELECT c_custkey, CAST(c_custkey AS DOUBLE) AS mostly, c_name AS rarely FROM customer WHERE c_custkey % 9 <> 0 UNION ALL SELECT c_custkey, NULL, c_name FROM customer WHERE c_custkey % 9 = 0")
def _(v):
    mostly = "CASE WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE CAST(c_custkey AS STRING) END"
    return gold.numeric_columns(v.sql(f"SELECT c_custkey, {mostly} AS mostly, c_name AS rarely FROM customer"))


def _report(keys: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return (
        f"SELECT a.*, 'current' AS data_era, {', '.join('b.' + n for n in gold.MATERNAL_RATES)} FROM (SELECT {keys}, {rates(gold.CHILD_RATES)}, count(visit_id) AS n FROM children GROUP BY {keys}) AS a "
        f"LEFT JOIN (SELECT {keys}, {rates(gold.MATERNAL_RATES)} FROM mothers GROUP BY {keys}) AS b ON {on}"
    )


_KIDS = ["visit_id", "household_id", "record_type", "visit_round", "survey_year", "visit_date", "province", "district", "union_council", "ses_tier", "stunted", "wasted", "underweight", "anemia", "diarrhea_2w", "vaccination_full"]


@query("gd11_district_report", _report("province, district, visit_round"))
def _(v):
    return gold.district_report(*_facts(v))


@query(
    "gd12_district_summary",
    f"""SELECT coalesce(a.province, b.province) AS province, coalesce(a.district, b.district) AS district, coalesce(a.visit_round, b.visit_round) AS visit_round,
    a.* EXCLUDE (province, district, visit_round), b.* EXCLUDE (province, district, visit_round) FROM
    (SELECT province, district, visit_round, {rates({('anemia_children_rate' if k == 'anemia_rate' else k): c for k, c in gold.CHILD_RATES.items()})}, count(visit_id) AS children_measured FROM children GROUP BY ALL) AS a
    FULL JOIN (SELECT province, district, visit_round, {rates(gold.MATERNAL_RATES)}, count(visit_id) AS women_assessed FROM mothers WHERE visit_round <> 3 GROUP BY ALL) AS b
    ON a.province = b.province AND a.district = b.district AND a.visit_round = b.visit_round""",
)
def _(v):
    return gold.district_summary(v("children"), v("mothers").where("visit_round <> 3"))


@query("gd13_province_report", _report("province, visit_round"))
def _(v):
    return gold.province_report(*_facts(v))


_TREND = rates({k: gold.CHILD_RATES[k] for k in ("stunting_rate", "wasting_rate", "underweight_rate", "anemia_rate")})


@query("gd14_annual_trend", f"SELECT province, survey_year, {_TREND} FROM children GROUP BY province, survey_year")
def _(v):
    return gold.annual_trend(v("children"))


@query("gd15_quarterly_report", f"SELECT district, CAST(date_trunc('quarter', visit_date) AS DATE) AS period_start, {rates(gold.CHILD_RATES)}, count(visit_id) AS n FROM children GROUP BY ALL")
def _(v):
    return gold.period_report(v("children"), "quarter")


@query("gd15_monthly_report", f"SELECT district, CAST(date_trunc('month', visit_date) AS DATE) AS period_start, {rates(gold.CHILD_RATES)}, count(visit_id) AS n FROM children GROUP BY ALL")
def _(v):
    return gold.period_report(v("children"), "month")


@query(
    "gd16_rolling_rate",
    f"""SELECT district, day, CAST(n AS BIGINT) AS n, CASE WHEN n > 0 THEN {r('k / n', 4)} END AS rate FROM (
    SELECT district, day, sum(c) OVER w AS n, CAST(sum(s) OVER w AS DOUBLE) AS k FROM (SELECT district, visit_date AS day, count(stunted) AS c, coalesce(sum(stunted), 0) AS s FROM children GROUP BY district, visit_date) AS t
    WINDOW w AS (PARTITION BY district ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)) AS u""",
)
def _(v):
    return gold.rolling_rate(v("children"), "stunted")


@query("gd17_year_over_year", f"SELECT province, survey_year, stunting_rate, {r('stunting_rate - lag(stunting_rate) OVER (PARTITION BY province ORDER BY survey_year)', 4)} AS change FROM (SELECT province, survey_year, {_TREND} FROM children GROUP BY province, survey_year) AS t")
def _(v):
    return gold.year_over_year(gold.annual_trend(v("children")))


_COLUMNS = ("household_id", "district", "province", "has_toilet", "consent_given", "ses_tier", "water_source", "enrollment_date", "enumerator_id", "respondent_age", "household_size", "gps_latitude", "gps_longitude", "muac_mm", "respondent_name")
_URDU = "regexp_matches({0}, 'پائپ|ہینڈ|کنواں|کم|درمیانہ|زیادہ')"


@query(
    "gd18_quality_report",
    f"""SELECT *, raw_rows - clean_rows AS rows_dropped, {r('1e2 * (raw_rows - clean_rows) / raw_rows', 1)} AS drop_pct, CASE WHEN missing_pct_raw < 15 AND duplicates_raw = 0 THEN 'OK' ELSE 'Review' END AS status FROM (
    SELECT 'households' AS dataset, count(*) AS raw_rows, {r(f"100 * ({' + '.join(f'avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)' for c in _COLUMNS)}) / {len(_COLUMNS)}", 1)} AS missing_pct_raw,
      count(*) - count(DISTINCT household_id) AS duplicates_raw, CAST({' + '.join(f'count(*) FILTER (WHERE {_URDU.format(c)})' for c in ('water_source', 'ses_tier', 'district'))} AS BIGINT) AS bilingual_values,
      count(*) FILTER (WHERE {yes_no('consent_given')} = 1) AS clean_rows, CAST({' + '.join(f'count(*) FILTER (WHERE {x})' for x in _ISSUES['households'][1].values())} AS BIGINT) AS dq_fixes_applied FROM raw_households) AS t""",
)
def _(v):
    """Fixes are counted while the clean rows are written."""
    raw, watch, path = v("raw_households"), Watch(), f"{scratch(v)}/households"
    files.write(silver.clean("households", raw, watch), path)
    cleaned = v.spark.read.parquet(path)
    fixes = table_of(v.spark, [("households", issue, n) for issue, n in watch.counts(cleaned.count()).items()])
    return gold.quality_report({"households": (raw, cleaned)}, fixes)


@query("gd19_bilingual", f"SELECT count(*) FILTER (WHERE {_URDU.format('water_source')}) AS water, count(*) FILTER (WHERE {_URDU.format('ses_tier')}) AS ses, count(*) FILTER (WHERE {_URDU.format('district')}) AS district FROM raw_households")
def _(v):
    from tamarisk.functions.cleaning import bilingual

    return v("raw_households").agg(*[F.count_if(bilingual(c)).alias(n) for n, c in (("water", "water_source"), ("ses", "ses_tier"), ("district", "district"))])


@query("gd20_pipeline_status", "SELECT 'silver' AS layer, 'households' AS dataset, count(*) AS rows, 12 AS columns, '2024-01-01' AS refreshed_at FROM households UNION ALL SELECT 'gold', 'children', count(*), 4, '2024-01-01' FROM children")
def _(v):
    return gold.pipeline_status({"silver": {"households": v("households")}, "gold": {"children": v("children").select("visit_id", "district", "stunted", "wasted")}}, "2024-01-01")


@query("gd24_legacy_enumerators", "SELECT visit_id, CASE WHEN enumerator_id % 2 = 0 THEN printf('E%03d', enumerator_id) ELSE printf('ENUM%03d', enumerator_id) END AS enumerator_id FROM visits")
def _(v):
    records = v("visits").select("visit_id", F.format_string("ENUM%03d", "enumerator_id").alias("enumerator_id"))
    registry = v("facilities").where("facility_id % 2 = 0").select(F.format_string("ENUM%03d", "facility_id").alias("legacy_enum_id"), F.format_string("E%03d", "facility_id").alias("enumerator_id"))
    return gold.legacy_enumerators(records, registry)


@query("gd25_snapshot_diff", f"WITH o AS ({_OLD}), n AS ({_INCOMING}) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'INSERT' WHEN n.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS _cdc_op FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.segment IS DISTINCT FROM n.segment")
def _(v):
    return scd.snapshot_diff(v.sql(_OLD), v.sql(_INCOMING), "id")


@query("gd26_as_of", f"WITH e AS ({_EXISTING}) SELECT o_orderkey, o_custkey AS id, segment, _scd_version FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN '2020-06-01' ELSE '2022-06-01' END AS moment FROM orders) AS f LEFT JOIN e ON o_custkey = id AND _scd_effective_from <= moment AND (_scd_effective_to IS NULL OR moment < _scd_effective_to)")
def _(v):
    facts = v("orders").select("o_orderkey", F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "2020-06-01").otherwise("2022-06-01").alias("at"))
    return scd.as_of(facts, v.sql(_EXISTING), "id", "at").select("o_orderkey", "id", "segment", "_scd_version")

"""Survey-shaped views over the given tables, as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tamarisk.functions import refdata
from tamarisk.sources.shared import checkpoint_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_DISTRICTS = ", ".join(
    f"({i}, '{name}', '{province}', {lat:.4f}, {lon:.4f}, {str(urban).lower()})" for i, (name, province, lat, lon, urban) in enumerate(refdata.DISTRICTS, 1)
)
#: Ways in which raw rows spell a district, by household number.
_DIRTY = ("'lahor'", "'LAHORE'", "'لاہور'", "'D.I. Khan'", "'MirpurKhas'", "'Khan'", "'R.Y.Khan'", "'  karachi '", "NULL", "district", "upper(district)", "'unknown place'")

VIEWS: dict[str, str] = {
    "districts": f"""
  SELECT CAST(r AS INT) AS rank, district, province, CAST(lat AS DOUBLE) AS centre_lat, CAST(lon AS DOUBLE) AS centre_lon, urban AS is_urban
  FROM (VALUES {_DISTRICTS}) AS v(r, district, province, lat, lon, urban)""",
    "households": """
  SELECT c_custkey AS household_id, province, district, concat(district, '-UC', CAST(c_custkey % 5 AS STRING)) AS union_council,
         CASE c_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'middle' ELSE 'high' END AS ses_tier,
         c_name AS respondent_name, CAST(c_custkey % 60 + 10 AS INT) AS respondent_age, CAST(c_custkey % 9 + 1 AS INT) AS household_size,
         2.4e1 + (c_custkey % 130) / 1e1 AS gps_latitude, 6.1e1 + (c_custkey % 160) / 1e1 AS gps_longitude,
         CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE 1 END AS consent_given,
         CASE WHEN c_custkey % 4 = 0 THEN 'urban' ELSE 'rural' END AS urban_rural
  FROM customer JOIN districts ON rank = c_nationkey + 1""",
    "visits": """
  SELECT l_orderkey * 10 + l_linenumber AS visit_id, h.household_id, h.province, h.district, h.union_council, h.ses_tier,
         CASE WHEN l_linestatus = 'O' THEN 'child' ELSE 'maternal' END AS record_type,
         CAST(l_linenumber % 4 + 1 AS INT) AS visit_round, CAST(l_shipdate AS DATE) AS visit_date, CAST(year(l_shipdate) AS INT) AS survey_year,
         l_suppkey AS enumerator_id, CAST(l_quantity AS INT) AS interview_duration_min,
         CAST(l_partkey % 62 AS INT) AS child_age_months, CASE WHEN l_partkey % 2 = 0 THEN 'male' ELSE 'female' END AS child_sex,
         CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS stunted,
         CASE WHEN l_discount >= 5e-2 THEN 1 ELSE 0 END AS wasted,
         CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS underweight, CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS severe_stunted,
         CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS severe_wasted, CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END AS anemia,
         CASE WHEN l_partkey % 5 = 0 THEN 1 WHEN l_partkey % 5 = 1 THEN NULL ELSE 0 END AS diarrhea_2w,
         CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS ari_2w, CASE WHEN l_partkey % 6 = 0 THEN 1 ELSE 0 END AS fever_2w,
         CASE WHEN l_partkey % 10 < 6 THEN 1 ELSE 0 END AS vaccination_full, CASE WHEN l_partkey % 9 < 4 THEN 1 ELSE 0 END AS exclusive_bf,
         (l_quantity - 2.5e1) / 4e0 AS haz_score, (l_quantity - 3e1) / 8e0 AS waz_score, (l_quantity - 2e1) / 8e0 AS whz_score,
         3e1 + l_quantity * 2e0 + (l_partkey % 20) AS height_cm, 1e0 + l_quantity * 6e-1 AS weight_kg,
         CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE 7e1 + (l_partkey % 140) END AS muac_mm,
         CAST(l_partkey % 55 + 8 AS INT) AS maternal_age, CASE WHEN l_partkey % 10 < 5 THEN 1 ELSE 0 END AS anc_4plus,
         CASE WHEN l_partkey % 10 < 7 THEN 1 ELSE 0 END AS last_delivery_skilled, 2e0 + (l_partkey % 200) / 1e1 AS hemoglobin_gdl,
         l_partkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN households h ON o_custkey = h.household_id""",
    "children": "\n  SELECT * FROM visits WHERE record_type = 'child'",
    "mothers": "\n  SELECT * FROM visits WHERE record_type = 'maternal'",
    "facilities": """
  SELECT s_suppkey AS facility_id, s_name AS facility_name, district, province,
         CASE s_suppkey % 3 WHEN 0 THEN 'DHQ' WHEN 1 THEN 'RHC' ELSE 'BHU' END AS facility_type, CAST(s_suppkey % 4 + 1 AS INT) AS visit_round,
         2.4e1 + (s_suppkey * 7 % 130) / 1e1 AS gps_latitude, 6.1e1 + (s_suppkey * 11 % 160) / 1e1 AS gps_longitude,
         CAST(s_suppkey * 13 % 101 AS DOUBLE) AS readiness_score,
         CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS stockout_ors, CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS stockout_zinc,
         CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS stockout_iron_folate
  FROM supplier JOIN districts ON rank = s_nationkey + 1""",
    "enumerator_performance": """
  SELECT user_id AS enumerator_id, concat('Enumerator ', CAST(user_id AS STRING)) AS enumerator_name, concat('D', CAST(user_id % 36 AS STRING)) AS district,
         CAST(ts AS DATE) AS date, count(*) AS submissions, round(avg(value), 6) AS avg_duration_min,
         CAST(sum(CASE WHEN value < 1e1 THEN 1 ELSE 0 END) AS BIGINT) AS short_interviews,
         CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS flagged_for_backcheck
  FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "backcheck": """
  SELECT visit_id AS original_visit_id, household_id, enumerator_id AS per_enumerator, visit_date,
         (l_partkey % 31) / 1e1 AS height_discrepancy_cm, (l_partkey % 7) / 1e1 AS weight_discrepancy_kg,
         CASE WHEN l_partkey % 8 = 0 THEN 0 ELSE 1 END AS morbidity_match,
         CASE WHEN l_partkey % 31 <= 20 AND l_partkey % 7 <= 5 AND l_partkey % 8 <> 0 THEN 1 ELSE 0 END AS overall_pass
  FROM visits WHERE record_type = 'child'""",
    "raw_households": f"""
  SELECT household_id, CASE household_id % {len(_DIRTY)} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_DIRTY))} END AS district,
         CASE WHEN household_id % 4 = 0 THEN NULL ELSE province END AS province,
         CASE household_id % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' NO ' WHEN 2 THEN 'ہاں' WHEN 3 THEN 'نہیں' WHEN 4 THEN NULL ELSE '2' END AS has_toilet,
         CASE household_id % 7 WHEN 0 THEN 'no' WHEN 1 THEN '0.5' WHEN 2 THEN 'Haan' ELSE 'yes' END AS consent_given,
         CASE household_id % 6 WHEN 0 THEN 'کم' WHEN 1 THEN 'Poor' WHEN 2 THEN 'RICH' WHEN 3 THEN 'درمیانہ' WHEN 4 THEN NULL ELSE ' middle ' END AS ses_tier,
         CASE household_id % 5 WHEN 0 THEN 'پائپ' WHEN 1 THEN 'tap' WHEN 2 THEN 'Borehole' WHEN 3 THEN 'well' ELSE NULL END AS water_source,
         CASE household_id % 5 WHEN 0 THEN '2022-03-09' WHEN 1 THEN '25/12/2021' WHEN 2 THEN '12/25/2021' WHEN 3 THEN '25.12.2021' ELSE 'unknown' END AS enrollment_date,
         CASE household_id % 5 WHEN 0 THEN concat('e', lpad(CAST(household_id % 108 AS STRING), 3, '0'))
              WHEN 1 THEN concat('ENU', lpad(CAST(household_id % 108 AS STRING), 3, '0')) WHEN 2 THEN 'ENUM007' WHEN 3 THEN '012' ELSE 'E009 ' END AS enumerator_id,
         CASE WHEN household_id % 11 = 0 THEN 'n/a' WHEN household_id % 13 = 0 THEN '999' WHEN household_id % 29 = 0 THEN 'nan' ELSE CAST(respondent_age AS STRING) END AS respondent_age,
         CAST(household_size * 4 AS STRING) AS household_size,
         CASE WHEN household_id % 17 = 0 THEN 0e0 WHEN household_id % 23 = 0 THEN NULL ELSE gps_latitude END AS gps_latitude,
         CASE WHEN household_id % 19 = 0 THEN NULL ELSE gps_longitude END AS gps_longitude,
         CASE WHEN household_id % 9 = 0 THEN 1.35e1 ELSE 1.1e2 + household_id % 40 END AS muac_mm,
         respondent_name
  FROM households""",
    "submissions": """
  SELECT user_id AS household_id, event_id, ts AS submission_time, event_type, value FROM events""",
}
_NEEDS = {
    "households": ("districts",), "visits": ("districts", "households"), "children": ("districts", "households", "visits"),
    "mothers": ("districts", "households", "visits"), "facilities": ("districts",), "backcheck": ("districts", "households", "visits"),
    "raw_households": ("districts", "households"),
}


def with_views(body: str, extra: str = "") -> str:
    """The query with the views that it names in front."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", f"{body} {extra}")]
    wanted = {x for v in named for x in (*_NEEDS.get(v, ()), v)}
    parts = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in wanted] + ([extra] if extra else [])
    return (f"WITH {', '.join(parts)} " if parts else "") + body


class Views:
    """Views and tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, body: str, **given: DataFrame) -> DataFrame:
        """The query's rows; tables that are given stand for those of the folder."""
        text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", with_views(body))
        return self.spark.sql(text, **{t: given.get(t) or self(t) for t in TABLES if f"{{{t}}}" in text})


def scratch(v: Views) -> str:
    """A new folder of the shared one."""
    return f"{checkpoint_dir(v.spark)}/{uuid4().hex}"

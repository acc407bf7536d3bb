"""Queries of the data service (AP), governance (GV) and geography (GE)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarisk.functions import privacy
from tamarisk.functions.geo import utm_sql
from tamarisk.operators import geospatial, governance, monitoring, serving
from tamarisk.plans.analytics_queries import KM
from tamarisk.plans.registry import query


@query("ap01_equal_filters", "SELECT household_id, district, ses_tier FROM households WHERE lower(district) = 'lahore' AND lower(ses_tier) = 'low'")
def _(v):
    found = serving.equal_to(v("households"), {"district": "LAHORE", "ses_tier": "Low", "nothing": "x"})
    return found.select("household_id", "district", "ses_tier")


@query("ap02_page", "SELECT household_id, district, (SELECT count(*) FROM households) AS total FROM households ORDER BY household_id LIMIT 50 OFFSET 100")
def _(v):
    return serving.page(v("households").select("household_id", "district"), ["household_id"], offset=100, limit=50)


@query("ap03_fields", "SELECT household_id, district FROM households")
def _(v):
    return serving.fields(v("households"), ["household_id", "district", "unknown"])


_EVENT_SCHEMA = (("event_id", "Event Id", "int"), ("ts", "Ts", "datetime"), ("user_id", "User Id", "int"), ("event_type", "Event Type", "string"), ("value", "Value", "float"), ("props", "Props", "string"))


@query("ap04_tool_schema", " UNION ALL ".join(f"SELECT '{c}' AS id, '{alias}' AS alias, '{kind}' AS type, count({c}) AS n_filled FROM events" for c, alias, kind in _EVENT_SCHEMA))
def _(v):
    """The schema with the number of values of each column."""
    events = v("events")
    filled = events.agg(*[F.count(c).alias(c) for c in events.columns]).unpivot([], events.columns, "id", "n_filled")
    return serving.tool_schema(events).join(filled, "id")


@query("ap05_plain", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, value FROM events")
def _(v):
    return serving.plain(v("events").select("event_id", "ts", "value", F.lit("gold").alias("_layer"), F.lit("f").alias("_source_file")))


@query("ap06_without_personal", "SELECT household_id, district, union_council, ses_tier FROM households")
def _(v):
    return serving.without_personal(v("households").select("household_id", "district", "union_council", "ses_tier", "respondent_name", "gps_latitude", "gps_longitude"))


def _pseudonym(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' THEN 'UNKNOWN' ELSE concat('ID_', upper(substr(sha256(concat('salt:', {c})), 1, 8))) END"


@query("gv01_pseudonym", f"SELECT household_id, {_pseudonym('n')} AS pseudonym FROM (SELECT household_id, CASE WHEN household_id % 7 = 0 THEN NULL WHEN household_id % 11 = 0 THEN '' ELSE respondent_name END AS n FROM households) AS t")
def _(v):
    name = F.when(F.col("household_id") % 7 == 0, F.lit(None)).when(F.col("household_id") % 11 == 0, "").otherwise(F.col("respondent_name"))
    return v("households").select("household_id", privacy.pseudonym(name, "salt").alias("pseudonym"))


@query("gv02_strip_personal", f"SELECT household_id, district, {_pseudonym('respondent_name')} AS respondent_name FROM households")
def _(v):
    return governance.strip_personal(v("households").select("household_id", "district", "respondent_name", "gps_latitude", "gps_longitude"), "salt")


@query("gv03_age_band", "SELECT household_id, concat(CAST(respondent_age // 5 * 5 AS VARCHAR), '-', CAST(respondent_age // 5 * 5 + 4 AS VARCHAR)) AS age_band FROM households")
def _(v):
    return v("households").select("household_id", privacy.age_band("respondent_age").alias("age_band"))


@query("gv04_masked_gps", "SELECT household_id, round(gps_latitude + 1e-3, 2) AS gps_latitude, round(gps_longitude + 1e-3, 2) AS gps_longitude FROM households")
def _(v):
    return v("households").select("household_id", privacy.masked_gps(F.col("gps_latitude") + 1e-3).alias("gps_latitude"), privacy.masked_gps(F.col("gps_longitude") + 1e-3).alias("gps_longitude"))


@query("gv05_audit_record", "SELECT 'analyst' AS user, 'export' AS action, 'households' AS \"table\", count(*) AS row_count FROM households")
def _(v):
    n = v("households").count()
    return governance.audit_record(v.spark, "analyst", "export", "households", n, "2024-01-01").drop("at")


@query(
    "gv06_codebook",
    " UNION ALL ".join(
        f"SELECT 'households' AS dataset, '{c}' AS field, '{kind}' AS type, '{pii}' AS pii, {about} AS description, round(100 * avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 1) AS missing_pct, "
        f"count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS minimum, CAST(max({c}) AS VARCHAR) AS maximum FROM raw_households"
        for c, kind, pii, about in (
            ("household_id", "bigint", "no", "'Unique household identifier'"), ("respondent_name", "string", "YES", "CAST(NULL AS VARCHAR)"), ("water_source", "string", "no", "CAST(NULL AS VARCHAR)")
        )
    ),
)
def _(v):
    df = v("raw_households").select("household_id", "respondent_name", "water_source")
    return governance.codebook(df, "households", {"household_id": "Unique household identifier"}, exact=True)


_X, _Y = utm_sql("gps_latitude", "gps_longitude")


@query("ge01_points", "SELECT household_id, gps_latitude, gps_longitude FROM raw_households WHERE gps_latitude IS NOT NULL AND gps_longitude IS NOT NULL")
def _(v):
    return geospatial.points(v("raw_households").select("household_id", "gps_latitude", "gps_longitude"))


@query("ge02_projected", f"SELECT household_id, round({_X}, 1) AS x_m, round({_Y}, 1) AS y_m FROM households")
def _(v):
    return geospatial.projected(v("households")).select("household_id", F.round("x_m", 1).alias("x_m"), F.round("y_m", 1).alias("y_m"))


_NEAR = f"""h AS (SELECT household_id, {_X} AS x, {_Y} AS y FROM households), f AS (SELECT facility_id, {_X} AS fx, {_Y} AS fy FROM facilities),
  near AS (SELECT household_id, min(sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy))) AS d FROM h, f GROUP BY household_id)"""


@query("ge03_nearest_facility", "SELECT household_id, round(d, 1) AS distance_m, d <= 5000 AS within_catchment FROM near", extra=_NEAR)
def _(v):
    return geospatial.nearest_facility(v("households").select("household_id", "gps_latitude", "gps_longitude"), v("facilities")).select("household_id", "distance_m", "within_catchment")


@query("ge04_catchment_counts", "SELECT count(*) AS households, count(*) FILTER (WHERE d <= 5000) AS within, count(*) FILTER (WHERE d > 5000) AS outside FROM near", extra=_NEAR)
def _(v):
    return geospatial.catchment_counts(geospatial.nearest_facility(v("households").select("household_id", "gps_latitude", "gps_longitude"), v("facilities")))


@query(
    "ge05_map_layer",
    """SELECT 'household' AS kind, CAST(household_id AS VARCHAR) AS id, gps_latitude, gps_longitude, CASE consent_given WHEN 1 THEN 'red' WHEN 0 THEN 'green' ELSE 'gray' END AS colour,
    CAST(NULL AS VARCHAR) AS facility_type, CAST(NULL AS INT) AS radius_m FROM households
    UNION ALL SELECT 'facility', CAST(facility_id AS VARCHAR), gps_latitude, gps_longitude, 'blue', facility_type, 5000 FROM facilities""",
)
def _(v):
    return geospatial.map_layer(v("households"), v("facilities"), "consent_given")


@query("ge06_far_from_centre", f"SELECT household_id, h.district, round({KM}, 1) AS km_from_centre FROM households h JOIN districts d ON h.district = d.district WHERE round({KM}, 1) > 100")
def _(v):
    return monitoring.far_from_centre(v("households"), v("districts")).select("household_id", "district", "km_from_centre")

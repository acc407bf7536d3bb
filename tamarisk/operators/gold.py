"""Gold layer: dimensions, facts, reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarisk.functions import refdata
from tamarisk.functions.cleaning import bilingual, province_of
from tamarisk.functions.numeric import percent, rounded, to_double
from tamarisk.operators.nutrition import known_keys
from tamarisk.operators.scd import first_by_key, initial_versions

#: Columns of the fact tables, in order, and what the rates are of (fixed values).
CHILD_FACT = (
    "visit_id", "record_id", "household_id", "data_era", "visit_round", "survey_year", "visit_date", "province", "district",
    "union_council", "ses_tier", "urban_rural", "child_age_months", "child_age_group", "child_sex", "haz_score", "waz_score",
    "whz_score", "stunted", "wasted", "underweight", "severe_stunted", "severe_wasted", "anemia", "diarrhea_2w", "ari_2w", "fever_2w",
    "vaccination_full", "exclusive_bf", "interview_duration_min", "short_interview_flag", "nearest_facility_id",
    "nearest_facility_type", "distance_to_facility_km", "_cdc_op", "_cdc_ts",
)
MATERNAL_FACT = (
    "visit_id", "record_id", "household_id", "data_era", "visit_round", "survey_year", "visit_date", "province", "district",
    "union_council", "ses_tier", "urban_rural", "maternal_age", "maternal_age_group", "currently_pregnant", "anc_4plus",
    "last_delivery_skilled", "anemia", "hemoglobin_gdl", "interview_duration_min", "short_interview_flag", "_cdc_op", "_cdc_ts",
)
CHILD_RATES = {
    "stunting_rate": "stunted", "wasting_rate": "wasted", "underweight_rate": "underweight", "anemia_rate": "anemia",
    "diarrhea_rate": "diarrhea_2w", "vaccination_rate": "vaccination_full",
}
MATERNAL_RATES = {"anemia_maternal_rate": "anemia", "anc_4plus_rate": "anc_4plus", "skilled_delivery_rate": "last_delivery_skilled"}


def dim_district(spark: SparkSession) -> DataFrame:
    rows = refdata.districts(spark).select(
        F.format_string("D%03d", "rank").alias("district_sk"), F.col("district").alias("district_nk"), F.col("district").alias("district_name"),
        "province", "is_urban", "centre_lat", "centre_lon",
    )
    return initial_versions(rows).withColumn("_layer", F.lit("gold"))


def dim_facility(facilities: DataFrame) -> DataFrame:
    """Facilities with their id as both keys."""
    names = [c for c in ("facility_name", "facility_type", "district", "province", "gps_latitude", "gps_longitude") if c in facilities.columns]
    rows = facilities.select(F.col("facility_id").alias("facility_sk"), F.col("facility_id").alias("facility_nk"), *names)
    return initial_versions(rows).withColumn("_layer", F.lit("gold"))


def with_household(visits: DataFrame, households: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Household attributes that the visits lack, by household."""
    missing = [c for c in wanted if c in households.columns and c not in visits.columns]
    return visits.join(households.select("household_id", *missing), "household_id", "left") if missing else visits


def union_eras(current: DataFrame | None, historical: DataFrame | None) -> DataFrame | None:
    """Rows of both eras by column name, tagged; what one lacks is NULL."""
    parts = [df.withColumn("data_era", F.lit(era)) for df, era in ((current, "current"), (historical, "historical")) if df is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True) if parts else None


def rounds_and_years(df: DataFrame) -> DataFrame:
    """Round from the survey year if no row has a round, then 1; year from the visit if there is no such column, then 2022."""
    names = set(df.columns)
    rounds = F.count("visit_round") if "visit_round" in names else F.lit(0)
    first = F.min(to_double("survey_year")).alias("first") if "survey_year" in names else F.lit(None).cast("double").alias("first")
    df = df.crossJoin(F.broadcast(df.agg(rounds.alias("_rounds"), first.alias("_first"))))  # one row
    year = to_double("survey_year") if "survey_year" in names else F.lit(None).cast("double")
    own = to_double("visit_round") if "visit_round" in names else F.lit(None).cast("double")
    derived = F.when(year.isNotNull(), F.greatest(year - F.col("_first") + 1, F.lit(1.0)))
    visit_year = F.year(F.col("visit_date").cast("timestamp")).cast("double") if "visit_date" in names else F.lit(None).cast("double")
    return df.withColumns({
        "visit_round": F.coalesce(F.when(F.col("_rounds") == 0, derived).otherwise(own), F.lit(1.0)).cast("int"),
        "survey_year": (year if "survey_year" in names else F.coalesce(visit_year, F.lit(2022.0))).cast("int"),
    }).drop("_rounds", "_first")


def keep(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def _fact(kind: str, visits: DataFrame | None, households: DataFrame | None, historical: DataFrame | None, wanted: Sequence[str], columns: Sequence[str]) -> DataFrame | None:
    current = None
    if visits is not None:
        current = visits.where(F.col("record_type") == kind) if "record_type" in visits.columns else visits
        if households is not None:
            current = with_household(current, households, wanted)
        if "district" in current.columns and "province" not in current.columns:
            current = current.withColumn("province", province_of("district"))
    both = union_eras(current, historical)
    return None if both is None else keep(rounds_and_years(both), columns)


def child_fact(visits: DataFrame | None, households: DataFrame | None = None, historical: DataFrame | None = None) -> DataFrame | None:
    """A row for each child visit of both eras with household attributes."""
    wanted = ("province", "ses_tier", "urban_rural", "nearest_facility_id", "nearest_facility_type", "distance_to_facility_km")
    return _fact("child", visits, households, historical, wanted, CHILD_FACT)


def maternal_fact(visits: DataFrame | None, households: DataFrame | None = None, historical: DataFrame | None = None) -> DataFrame | None:
    return _fact("maternal", visits, households, historical, ("province", "ses_tier", "urban_rural"), MATERNAL_FACT)


#: How every text starts that a cast takes for a number.
_NUMBER_STARTS = r"^[\x00-\x20]*[-+]?([.0-9]|[iI][nN][fF])"


def numeric_columns(df: DataFrame) -> DataFrame:
    """String columns of which more than half of all rows are numbers become doubles (one extra pass)."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if not texts:
        return df
    # Texts that can't be numbers are told by their first letters, as a cast that fails costs much more.
    share = df.agg(F.count("*").alias("_all"), *[F.count(F.when(F.col(f"`{c}`").rlike(_NUMBER_STARTS), to_double(f"`{c}`"))).alias(c) for c in texts]).first()
    return df.withColumns({c: to_double(f"`{c}`") for c in texts if 2 * share[c] > share["_all"]})


def _rates(df: DataFrame, keys: Sequence[str], rates: Mapping[str, str], digits: int = 4, counts: Mapping[str, Column] | None = None) -> DataFrame:
    found = {name: c for name, c in rates.items() if c in df.columns}
    aggs = [rounded(F.avg(to_double(c)), digits).alias(name) for name, c in found.items()]
    return known_keys(df, keys).groupBy(*keys).agg(*aggs, *[x.alias(n) for n, x in (counts or {}).items()])


def _n(df: DataFrame) -> Column:
    return F.count(F.coalesce(*[F.col(c).cast("string") for c in ("visit_id", "record_id") if c in df.columns]))


def kpi_report(children: DataFrame, mothers: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Child rates and counts by the keys, with the mothers' rates of the same group."""
    out = _rates(children, keys, CHILD_RATES, counts={"n": _n(children)})
    return out if mothers is None else out.join(_rates(mothers, keys, MATERNAL_RATES), list(keys), "left")


def district_report(children: DataFrame, mothers: DataFrame | None) -> DataFrame:
    return kpi_report(children, mothers, ["province", "district", "visit_round", "data_era"])


def province_report(children: DataFrame, mothers: DataFrame | None) -> DataFrame:
    return kpi_report(children, mothers, ["province", "visit_round", "data_era"])


def district_summary(children: DataFrame, mothers: DataFrame) -> DataFrame:
    """Districts and rounds of either fact, with both counts."""
    keys = ["province", "district", "visit_round"]
    names = {k if k != "anemia_rate" else "anemia_children_rate": v for k, v in CHILD_RATES.items()}
    left = _rates(children, keys, names, counts={"children_measured": F.count("visit_id")})
    right = _rates(mothers, keys, MATERNAL_RATES, counts={"women_assessed": F.count("visit_id")})
    return left.join(right, keys, "full_outer")


def annual_trend(children: DataFrame) -> DataFrame:
    names = ("stunting_rate", "wasting_rate", "underweight_rate", "anemia_rate")
    return _rates(children, ["province", "survey_year"], {k: CHILD_RATES[k] for k in names})


def period_report(children: DataFrame, period: str, rates: Mapping[str, str] | None = None) -> DataFrame:
    """Rates by district and calendar month or quarter of the visit."""
    dated = children.withColumn("period_start", F.to_date(F.date_trunc(period, F.col("visit_date").cast("timestamp"))))
    return _rates(dated, ["district", "period_start"], rates or CHILD_RATES, counts={"n": _n(children)})


def rolling_rate(children: DataFrame, indicator: str, key: str = "district", days: int = 30) -> DataFrame:
    """For each group and day with a visit, the rate over that day and the ``days - 1`` days before."""
    rows = known_keys(children, [key, "visit_date"]).withColumn("day", F.col("visit_date").cast("date"))
    daily = rows.groupBy(key, "day").agg(F.count(to_double(indicator)).alias("_n"), F.coalesce(F.sum(to_double(indicator)), F.lit(0.0)).alias("_k"))
    window = Window.partitionBy(key).orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    out = daily.withColumns({"n": F.sum("_n").over(window), "k": F.sum("_k").over(window)})
    return out.select(key, "day", "n", F.when(F.col("n") > 0, rounded(F.col("k") / F.col("n"), 4)).alias("rate"))


def year_over_year(trend: DataFrame, rate: str = "stunting_rate", key: str = "province", year: str = "survey_year") -> DataFrame:
    """Change of the rate from the year before in the table."""
    last = F.lag(rate).over(Window.partitionBy(key).orderBy(year))
    return trend.select(key, year, rate, rounded(F.col(rate) - last, 4).alias("change"))


def _repeats(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``duplicates_raw``: rows whose key was there before; rows without a key repeat each other.

    Keys are counted apart from the shares of missing values, which would else be carried along with every key.
    """
    if not keys:
        return raw.sparkSession.createDataFrame([(0,)], "duplicates_raw long")
    key = F.coalesce(F.col(keys[0]).cast("string"), F.lit("\0"))
    return raw.groupBy(key.alias("key")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates_raw"))


def quality_report(datasets: Mapping[str, tuple[DataFrame, DataFrame]], fixes: DataFrame | None = None) -> DataFrame:
    """One row for each dataset's raw and clean rows: dropped, missing, repeated keys, bilingual values, status."""
    parts = []
    for name, (raw, cleaned) in datasets.items():
        keys = [c for c in ("household_id", "visit_id", "assessment_id", "record_id") if c in raw.columns]
        texts = [c for c in ("water_source", "ses_tier", "district") if c in raw.columns]
        missing = sum((F.avg(F.col(f"`{c}`").isNull().cast("int")) for c in raw.columns), F.lit(0.0)) / max(1, len(raw.columns))
        urdu = sum((F.count_if(bilingual(c)) for c in texts), F.lit(0).cast("long"))
        a = raw.agg(F.count("*").alias("raw_rows"), rounded(100 * missing, 1).alias("missing_pct_raw"), urdu.alias("bilingual_values"))
        b = cleaned.agg(F.count("*").alias("clean_rows"))
        parts.append(a.crossJoin(_repeats(raw, keys)).crossJoin(b).select("raw_rows", "missing_pct_raw", "duplicates_raw", "bilingual_values", "clean_rows", F.lit(name).alias("dataset")))  # one row each
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.where("raw_rows > 0").withColumn("rows_dropped", F.col("raw_rows") - F.col("clean_rows"))
    if fixes is not None:
        out = out.join(fixes.groupBy("dataset").agg(F.sum("n").alias("dq_fixes_applied")), "dataset", "left").na.fill(0, ["dq_fixes_applied"])
    ok = (F.col("missing_pct_raw") < 15) & (F.col("duplicates_raw") == 0)
    return out.withColumns({"drop_pct": percent(F.col("rows_dropped"), F.col("raw_rows")), "status": F.when(ok, "OK").otherwise("Review")})


def pipeline_status(layers: Mapping[str, Mapping[str, DataFrame]], now: str) -> DataFrame:
    """``layer, dataset, rows, columns, refreshed_at`` of every table."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(layer).alias("layer"), F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns"), F.lit(now).alias("refreshed_at")
        )
        for layer, tables in layers.items()
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def legacy_enumerators(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Records with the present enumerator id: that of the registry for old ids, else their own."""
    names = registry.where("legacy_enum_id is not null").groupBy("legacy_enum_id").agg(F.min("enumerator_id").alias("_new"))
    out = records.join(names, records["enumerator_id"] == names["legacy_enum_id"], "left")
    return out.withColumn("enumerator_id", F.coalesce("_new", "enumerator_id")).drop("_new", "legacy_enum_id")


def build(
    silver: Mapping[str, DataFrame], bronze: Mapping[str, DataFrame], spark: SparkSession, now: str, fixes: DataFrame | None = None,
    save: Callable[[str, DataFrame], DataFrame] = lambda _, df: df,
) -> dict[str, DataFrame]:
    """All tables of the layer that have a source, with columns that hold mostly numbers as such, and the status of all layers.

    ``save`` gets each table when it is made; what it returns is what later tables are made from.
    """
    children = child_fact(silver.get("followup_visits"), silver.get("households"), silver.get("2020_child_nutrition"))
    mothers = maternal_fact(silver.get("followup_visits"), silver.get("households"), silver.get("2021_maternal_health"))
    # Columns that hold mostly numbers become numbers here, before the reports read them.
    names = ("fct_child_nutrition", "fct_maternal_health")
    children, mothers = (None if df is None else save(name, numeric_columns(df)) for name, df in zip(names, (children, mothers), strict=True))
    out: dict[str, DataFrame | None] = {"dim_district": dim_district(spark), **dict(zip(names, (children, mothers), strict=True))}
    if "facility_assessments" in silver and "facility_id" in silver["facility_assessments"].columns:
        out["dim_facility"] = numeric_columns(dim_facility(first_by_key(silver["facility_assessments"], "facility_id")))
    if children is not None:
        if {"province", "district"} <= set(children.columns):
            out["rpt_district_summary"] = district_report(children, mothers)
            out["rpt_province_summary"] = province_report(children, mothers)
        if "province" in children.columns:
            out["rpt_annual_trend"] = annual_trend(children)
    shared = {k: (bronze[k], silver[k]) for k in bronze if k in silver}
    if shared:
        out["rpt_data_quality"] = quality_report(shared, fixes)
    tables = {k: v if k in names else save(k, v) for k, v in out.items() if v is not None}
    tables["rpt_pipeline_status"] = save("rpt_pipeline_status", pipeline_status({"bronze": bronze, "silver": silver, "gold": tables}, now))
    return tables

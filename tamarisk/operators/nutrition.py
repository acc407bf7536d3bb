"""Prevalence of nutrition indicators. Rows without a group key are left out of grouped results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.numeric import rounded, to_double

#: Result name and source column of the child indicators (fixed values).
INDICATORS = {
    "stunting_rate": "stunted", "wasting_rate": "wasted", "underweight_rate": "underweight", "severe_stunting": "severe_stunted",
    "severe_wasting": "severe_wasted", "anemia_rate": "anemia", "diarrhea_rate": "diarrhea_2w", "ari_rate": "ari_2w",
    "fever_rate": "fever_2w",
}
Z_95 = 1.959963984540054


def known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(keys)) if keys else df


def _present(df: DataFrame, indicators: Mapping[str, str]) -> dict[str, str]:
    return {name: c for name, c in indicators.items() if c in df.columns}


def prevalence_by_group(df: DataFrame, keys: Sequence[str], indicators: Mapping[str, str] | None = None, min_n: int = 10) -> DataFrame:
    """``keys, n`` and the mean of each indicator to 3 digits; rates of groups below ``min_n`` visits are NULL."""
    found = _present(df, indicators or INDICATORS)
    out = known_keys(df, keys).groupBy(*keys).agg(F.count("visit_id").alias("n"), *[F.avg(to_double(c)).alias(name) for name, c in found.items()])
    return out.withColumns({name: F.when(F.col("n") >= min_n, rounded(F.col(name), 3)) for name in found})


def national_prevalence(df: DataFrame) -> DataFrame:
    """One row: number of rows and all rates."""
    return df.agg(F.count("*").alias("n"), *[rounded(F.avg(to_double(c)), 3).alias(name) for name, c in _present(df, INDICATORS).items()])


def wilson(k: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval in [0, 1] to 3 digits; (0, 0) for no observation."""
    n = n.cast("double")
    p, z2 = k / n, z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    margin = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    bound = lambda c: F.when(n == 0, F.lit(0.0)).otherwise(rounded(c, 3))
    return bound(F.greatest(F.lit(0.0), centre - margin)), bound(F.least(F.lit(1.0), centre + margin))


def prevalence_trend(df: DataFrame, indicator: str, group: str | None = "district", min_n: int = 10) -> DataFrame:
    """Rate and confidence interval by group and round, for groups with ``min_n`` observations."""
    source = INDICATORS.get(indicator, indicator)
    if source not in df.columns:
        raise ValueError(f"no column {source}")
    keys = [*([group] if group else []), "visit_round"]
    value = to_double(source)
    out = known_keys(df, keys).groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("k")).where(F.col("n") >= min_n)
    low, high = wilson(F.col("k"), F.col("n"))
    return out.select(*keys, "n", rounded(F.col("k") / F.col("n"), 3).alias("rate"), low.alias("ci_lower"), high.alias("ci_upper"))


def by_ses(df: DataFrame, indicator: str) -> DataFrame:
    return prevalence_by_group(df, ["ses_tier", "visit_round"], {indicator: INDICATORS.get(indicator, indicator)})


def by_age_and_sex(df: DataFrame, indicator: str, all_levels: bool = False) -> DataFrame:
    """By age group and sex; ``all_levels`` adds combinations without a row (n = 0)."""
    keys = ["child_age_group", "child_sex"]
    out = prevalence_by_group(df, keys, {indicator: INDICATORS.get(indicator, indicator)})
    if not all_levels:
        return out
    levels = [known_keys(df, [k]).select(k).distinct() for k in keys]
    # A handful of levels of either key.
    return levels[0].crossJoin(levels[1]).join(out, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def double_burden(df: DataFrame) -> DataFrame:
    """Stunted and wasted at once, by district and round; a missing flag counts as no."""
    both = F.coalesce((F.col("stunted") == 1) & (F.col("wasted") == 1), F.lit(False)).cast("int")
    return known_keys(df, ["district", "visit_round"]).groupBy("district", "visit_round").agg(
        F.count("visit_id").alias("n"),
        rounded(F.avg(to_double("stunted")), 3).alias("stunting_rate"),
        rounded(F.avg(to_double("wasted")), 3).alias("wasting_rate"),
        rounded(F.avg(both), 3).alias("double_burden_rate"),
    )


FIELDS = ("height_cm", "weight_kg", "muac_mm", "haz_score", "waz_score", "whz_score")


def completeness(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """``field, completeness_pct`` of the children's measurements."""
    rows = df.where(F.col("record_type") == "child") if "record_type" in df.columns else df
    have = [c for c in fields if c in df.columns]
    wide = rows.agg(*[rounded(100 * F.avg(F.col(c).isNotNull().cast("int")), 1).alias(c) for c in have])
    return wide.unpivot([], have, "field", "completeness_pct")


def derive_indicators(df: DataFrame) -> DataFrame:
    """Indicator flags from measurements: z below -2 (severe: -3), hemoglobin below 11, arm circumference classes."""
    flag = lambda c, limit: F.when(F.col(c).isNotNull(), (F.col(c) < limit).cast("int"))
    out = {}
    for name, c, limit in (
        ("stunted", "haz_score", -2), ("wasted", "whz_score", -2), ("underweight", "waz_score", -2), ("severe_stunted", "haz_score", -3),
        ("severe_wasted", "whz_score", -3), ("anemia", "hemoglobin_gdl", 11),
    ):
        if c in df.columns:
            out[name] = flag(c, limit)
    if "muac_mm" in df.columns:
        out["muac_class"] = F.when(F.col("muac_mm") < 115, "SAM").when(F.col("muac_mm") < 125, "MAM").when(F.col("muac_mm").isNotNull(), "normal")
    return df.withColumns(out)

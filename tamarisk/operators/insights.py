"""Comparisons, rankings and rates that reports and dashboards show."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.functions.cleaning import title_case
from tamarisk.functions.numeric import rounded, to_double
from tamarisk.operators.nutrition import known_keys
from tamarisk.sources.shared import cut

#: Targets of the programme (fixed values).
TARGETS = {"vaccination_full": 0.90, "exclusive_bf": 0.50, "anc_4plus": 0.80, "last_delivery_skilled": 0.80}


def group_rates(df: DataFrame, key: str, indicator: str) -> DataFrame:
    return known_keys(df, [key]).groupBy(key).agg(F.avg(to_double(indicator)).alias("rate"), F.count("*").alias("n")).where("rate is not null")


def extremes(df: DataFrame, indicator: str, key: str = "district") -> DataFrame:
    """One row: worst and best group, their rates, the overall mean and the worst group's distance to it in points."""
    rates = group_rates(df, key, indicator).agg(
        F.max_by(F.struct(key, "rate"), F.struct("rate", key)).alias("w"), F.min_by(F.struct(key, "rate"), F.struct("rate", key)).alias("b")
    )
    overall = df.agg(F.avg(to_double(indicator)).alias("overall"))
    gap = rounded(100 * (F.col("w.rate") - F.col("overall")), 1)
    return rates.crossJoin(overall).select(  # one row each
        F.col(f"w.{key}").alias("worst"), rounded(F.col("w.rate"), 4).alias("worst_rate"), F.col(f"b.{key}").alias("best"),
        rounded(F.col("b.rate"), 4).alias("best_rate"), rounded(F.col("overall"), 4).alias("overall_rate"), gap.alias("gap_pp"),
    )


def ses_gap(df: DataFrame, indicator: str) -> DataFrame:
    """Low minus high tier in points."""
    rate = lambda tier: F.avg(F.when(F.col("ses_tier") == tier, to_double(indicator)))
    return df.agg(rounded(rate("low"), 4).alias("low_rate"), rounded(rate("high"), 4).alias("high_rate"), rounded(100 * (rate("low") - rate("high")), 1).alias("gap_pp"))


def round_change(df: DataFrame, indicator: str, key: str = "visit_round") -> DataFrame:
    """Rate of the first and the last round, and the direction between them."""
    rates = group_rates(df, key, indicator)
    out = rates.agg(F.min_by("rate", key).alias("first_rate"), F.max_by("rate", key).alias("last_rate"))
    change = rounded(100 * (F.col("last_rate") - F.col("first_rate")), 1)
    direction = F.when(F.col("change_pp") > 0, "up").when(F.col("change_pp") < 0, "down").otherwise("flat")
    out = out.withColumn("change_pp", change).withColumn("direction", direction)
    return out.withColumns({c: rounded(F.col(c), 4) for c in ("first_rate", "last_rate")})


def district_ranking(df: DataFrame, indicator: str, least: float = 0.5) -> DataFrame:
    """Mean over rounds of the districts' rates in percent (not below ``least``), with visits; worst first."""
    by_round = known_keys(df, ["district", "visit_round"]).groupBy("district", "visit_round")
    by_round = by_round.agg(F.avg(to_double(indicator)).alias("rate"), F.count("visit_id").alias("n"))
    out = by_round.groupBy("district").agg(F.avg("rate").alias("rate"), F.sum("n").alias("n")).where("rate is not null")
    return out.select("district", F.greatest(rounded(100 * F.col("rate"), 1), F.lit(least)).alias("rate_pct"), "n").orderBy(F.desc("rate_pct"), "district")


def readiness(facilities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean readiness by the keys; a facility round may be called ``assessment_round``."""
    df = facilities.withColumnRenamed("assessment_round", "visit_round")
    return known_keys(df, keys).groupBy(*keys).agg(rounded(F.avg(to_double("readiness_score")), 1).alias("readiness"), F.count("*").alias("n"))


def stockout_rates(facilities: DataFrame) -> DataFrame:
    """``commodity, stockout_pct``, a row for each ``stockout_`` column."""
    cols = [c for c in facilities.columns if c.startswith("stockout_")]
    wide = facilities.agg(*[rounded(100 * F.avg(to_double(c)), 1).alias(c) for c in cols]).unpivot([], cols, "commodity", "stockout_pct")
    return wide.withColumn("commodity", title_case(F.regexp_replace(F.regexp_replace("commodity", "^stockout_", ""), "_", " ")))


def share_at_least(df: DataFrame, column: str, limit: float) -> DataFrame:
    value = to_double(column)
    return df.agg(rounded(F.avg(F.when(value.isNotNull(), (value >= limit).cast("int"))), 4).alias("share"), F.count(value).alias("n"))


def top_groups(df: DataFrame, indicator: str, key: str = "district", n: int = 20) -> DataFrame:
    rates = group_rates(df, key, indicator).select(key, rounded(F.col("rate"), 4).alias("rate"), "n")
    return rates.orderBy(F.desc("rate"), key).limit(n)


def indicator_table(df: DataFrame, indicators: Mapping[str, str], key: str = "province") -> DataFrame:
    """``key, indicator, rate`` in long form."""
    wide = known_keys(df, [key]).groupBy(key).agg(*[rounded(F.avg(to_double(c)), 4).alias(name) for name, c in indicators.items()])
    return wide.unpivot([key], list(indicators), "indicator", "rate")


#: Groups up to this number are broadcast with their brackets.
BROADCAST_GROUPS = 100_000


def exact_quantiles(rows: DataFrame, key: str, value: str, shares: Sequence[float], *aggs: Column, accuracy: int = 10_000) -> DataFrame:
    """``key``, ``n``, ``q``: an array of interpolated quantiles of each group, exact, and further ``aggs``.

    A sketch of bounded size brackets each quantile first (its ranks are off by a share of 1 / ``accuracy``). Of the
    rows outside a bracket only the number below it is kept, and values in it are counted, so no aggregation holds a
    group's values. Where a bracket misses its rank after all, all values of that group are counted. ``rows`` have
    neither null keys nor null values.
    """
    sketch = F.percentile_approx(value, F.array(*[F.lit(min(max(s + side * 2 / accuracy, 0.0), 1.0)) for s in shares for side in (-1, 1)]), accuracy)
    groups = rows.groupBy(key).agg(F.count("*").alias("n"), sketch.alias("_ends"), *aggs)
    brackets = [F.struct(F.lit(i).alias("i"), (F.lit(s) * (F.col("n") - 1)).alias("rank"), F.col("_ends")[2 * i].alias("low"), F.col("_ends")[2 * i + 1].alias("high")) for i, s in enumerate(shares)]
    groups = cut(groups.withColumn("_brackets", F.array(*brackets)).drop("_ends"))
    found = cut(_in_brackets(rows, key, value, groups))
    missed = groups.join(found.where("v is null").select(key).distinct(), key, "left_semi")
    if not missed.isEmpty():
        wide = F.transform("_brackets", lambda b: b.withField("low", F.lit(float("-inf"))).withField("high", F.lit(float("inf"))))
        again = _in_brackets(rows, key, value, missed.withColumn("_brackets", wide))
        found = found.join(missed.select(key), key, "left_anti").unionByName(again)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])
    return groups.drop("_brackets").join(found.groupBy(key).agg(ordered.alias("q")), key)


def _in_brackets(rows: DataFrame, key: str, value: str, groups: DataFrame) -> DataFrame:
    """``key, i, v``: the i-th quantile, null if its bracket doesn't hold its rank."""
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    brackets = groups.select(key, "_brackets")
    met = rows.select(key, F.col(value).alias("x")).join(F.broadcast(brackets) if few else brackets, key)
    each = met.select(key, "x", F.explode(F.filter("_brackets", lambda b: F.col("x") <= b["high"])).alias("b"))
    counted = each.groupBy(key, "b", F.when(F.col("x") >= F.col("b.low"), F.col("x")).alias("x")).agg(F.count("*").alias("m"))
    until = F.sum("m").over(Window.partitionBy(key, "b").orderBy(F.col("x").asc_nulls_first()))
    counted = counted.withColumn("until", until)
    at = lambda k: F.min(F.when(F.col("until") > k, F.struct("until", "x")))["x"]
    pairs = counted.groupBy(key, "b").agg(at(F.floor("b.rank")).alias("low"), at(F.ceil("b.rank")).alias("high"), F.max(F.when(F.col("x").isNull(), F.col("until"))).alias("below"))
    inside = F.coalesce(F.col("below") <= F.floor("b.rank"), F.lit(True)) & F.col("high").isNotNull()
    v = F.col("low") + (F.col("high") - F.col("low")) * (F.col("b.rank") - F.floor("b.rank"))
    return pairs.select(key, F.col("b.i").alias("i"), F.when(inside, v).alias("v"))


def distribution(df: DataFrame, value: str, key: str, low: float) -> DataFrame:
    """Quartiles, extremes and the share below ``low`` of each group."""
    rows = known_keys(df.select(key, to_double(value).alias("_x")).where("_x is not null"), [key])
    aggs = [F.min("_x").alias("minimum"), F.max("_x").alias("maximum"), rounded(F.avg((F.col("_x") < low).cast("int")), 4).alias("share_below")]
    out = exact_quantiles(rows, key, "_x", (0.25, 0.5, 0.75), *aggs)
    q = [F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(("q1", "median", "q3"))]
    return out.select(key, "n", "minimum", *q, "maximum", "share_below")


def maternal_rates(df: DataFrame, indicator: str, keys: Sequence[str]) -> DataFrame:
    return known_keys(df, keys).groupBy(*keys).agg(rounded(F.avg(to_double(indicator)), 4).alias("rate"), F.count("*").alias("n"))


def national_kpis(children: DataFrame, mothers: DataFrame, facilities: DataFrame) -> DataFrame:
    """One row over three tables."""
    a = children.agg(
        F.count("*").alias("children"), rounded(F.avg(to_double("stunted")), 4).alias("stunting_rate"), rounded(F.avg(to_double("wasted")), 4).alias("wasting_rate"),
        F.count_distinct("district").alias("districts"),
    )
    b = mothers.agg(F.count("*").alias("mothers"), rounded(F.avg(to_double("anc_4plus")), 4).alias("anc_4plus_rate"))
    c = facilities.agg(F.count("*").alias("facilities"), rounded(F.avg(to_double("readiness_score")), 1).alias("readiness"))
    return a.crossJoin(b).crossJoin(c)


def cohort(df: DataFrame, **levels: str | int | None) -> DataFrame:
    """Rows of the given province, district and round; a level of None or ``All`` doesn't filter."""
    for name, level in levels.items():
        if level not in (None, "All") and name in df.columns:
            df = df.where(F.col(name) == level)
    return df


def as_fractions(df: DataFrame, columns: Sequence[str], above: float = 1.5) -> DataFrame:
    """Columns whose maximum shows that they hold percentages are divided by 100."""
    most = df.agg(*[F.max(to_double(c)).alias(f"_max_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(most))  # one row
    out = out.withColumns({c: F.when(F.col(f"_max_{c}") > above, to_double(c) / 100).otherwise(to_double(c)) for c in columns})
    return out.drop(*[f"_max_{c}" for c in columns])


def levels(df: DataFrame, column: str, **within: str) -> DataFrame:
    """Sorted distinct values, of the rows in the given parent levels."""
    return cohort(df, **within).where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def latest(df: DataFrame, at: str, n: int = 10, *tie: str) -> DataFrame:
    """The newest rows with the number of all rows beside them."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(F.col(at).desc_nulls_last(), *tie).limit(n).crossJoin(F.broadcast(total))  # one row


def change_counts(df: DataFrame, op: str = "_cdc_op") -> DataFrame:
    return known_keys(df, [op]).groupBy(op).agg(F.count("*").alias("n"))


def double_burden_bound(report: DataFrame) -> DataFrame:
    """Upper bound of the double burden of a district: the smaller of its mean stunting and wasting rates, in percent."""
    means = known_keys(report, ["district"]).groupBy("district").agg(F.avg("stunting_rate").alias("s"), F.avg("wasting_rate").alias("w"))
    pct = lambda c: rounded(100 * c, 1)
    return means.select("district", pct(F.col("s")).alias("stunting_pct"), pct(F.col("w")).alias("wasting_pct"), pct(F.least("s", "w")).alias("double_burden_max_pct"))


def target_attainment(df: DataFrame, key: str, targets: Mapping[str, float] | None = None) -> DataFrame:
    """``key, indicator, rate, target, met`` for the indicators that have a target."""
    found = {c: t for c, t in (targets or TARGETS).items() if c in df.columns}
    goals = F.create_map(*[F.lit(x) for c, t in found.items() for x in (c, t)])
    long = indicator_table(df, {c: c for c in found}, key).withColumn("target", F.element_at(goals, F.col("indicator")))
    return long.withColumn("met", F.col("rate") >= F.col("target"))

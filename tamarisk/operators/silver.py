"""Cleaning jobs: each takes raw rows and returns clean rows; a ``Watch`` given to it counts what was fixed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions import cleaning as C
from tamarisk.functions import refdata
from tamarisk.functions.numeric import clamped, null_outside, to_double
from tamarisk.operators.scd import INPUT_ORDER, first_by_key, first_of_few, row_hash, snapshot_diff, tag_changes
from tamarisk.operators.watch import Watch
from tamarisk.sources.shared import cut

LINEAGE = ("_source_file", "_source_era", "_source_type", "_ingested_at", "_load_type", "_layer")
KEYS = ("household_id", "visit_id", "assessment_id", "backcheck_id", "record_id")
#: Fields and bounds of the survey (fixed values).
VISIT_FLAGS = ("anemia", "diarrhea_2w", "ari_2w", "fever_2w", "vaccination_full", "currently_pregnant", "anc_4plus", "last_delivery_skilled")
VISIT_NUMBERS = (
    "child_age_months", "height_cm", "weight_kg", "muac_mm", "haz_score", "waz_score", "whz_score", "hemoglobin_gdl", "maternal_age",
    "interview_duration_min",
)
Z_SCORES = ("haz_score", "waz_score", "whz_score")
CHILD_LIMITS = {"height_cm": (40.0, 130.0), "weight_kg": (1.5, 30.0), "muac_mm": (80.0, 200.0)}
GENERIC_FLAGS = ("has_toilet", "consent_given", "has_electricity", "has_water", "stunted", "wasted", "underweight", "anemia", "vaccination_full")


def normal_headers(df: DataFrame, dots: bool = False) -> DataFrame:
    """Trimmed lower-case names with ``_`` for a space (and for a dot)."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    return df.toDF(*[n.replace(".", "_") if dots else n for n in names])


def rename_legacy(df: DataFrame, mapping: Mapping[str, str] = refdata.LEGACY_HEADERS) -> DataFrame:
    """Historical names to present ones, once; columns that meet under one name are coalesced in order.

    A registry of enumerators keeps ``sex``; elsewhere ``sex`` is the child's.
    """
    mapping = dict(mapping) | {k.replace(".", "_"): v for k, v in mapping.items() if "." in k} | {k.lower(): v for k, v in mapping.items()}
    if not {"child_record_no", "age_months", "haz"} & set(df.columns):
        mapping.pop("sex", None)
    target: dict[str, list[str]] = {}
    for c in sorted(df.columns, key=lambda c: c in mapping):  # present names first
        target.setdefault(mapping.get(c, c), []).append(c)
    order = list(dict.fromkeys(mapping.get(c, c) for c in df.columns))
    return df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in target[n]]).alias(n) for n in order])


#: What functions of texts come to for columns of other kinds, which needn't be made texts and read again.
_OF_KIND: dict[tuple[Callable[[str], Column], str], Callable[[str], Column]] = {
    **{(C.yes_no, kind): lambda c: F.when(F.col(c) != 0, 1).when(F.col(c) == 0, 0) for kind in ("tinyint", "smallint", "int")},
    **{(C.enumerator_id, kind): lambda c: F.col(c).cast("string") for kind in ("tinyint", "smallint", "int", "bigint")},
    (C.parse_date, "date"): lambda c: F.col(c).cast("timestamp"), (C.parse_date, "timestamp"): lambda c: F.col(c),
}
Issues = Mapping[str, tuple[str, Callable[[Column, Column], Column]]]


def apply(df: DataFrame, changes: Mapping[str, Callable[[str], Column]], watch: Watch | None = None, lost: str | None = None, issues: Issues | None = None) -> DataFrame:
    """The changes whose column is there, all from the values before.

    With a watch, rows are counted by ``issues``: name to column and a test of its old and new value, each computed once.
    """
    kinds = dict(df.dtypes)
    new = {c: _OF_KIND.get((f, kinds[c]), f)(c) for c, f in changes.items() if c in kinds}
    if watch is None:
        return df.withColumns(new)
    both = df.withColumns({f"_new_{c}": x for c, x in new.items()})
    both = watch.at(both, lost, **{k: test(F.col(c), F.col(f"_new_{c}")) for k, (c, test) in (issues or {}).items() if c in new})
    return both.select(*[F.col(f"_new_{c}").alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])


#: Distinct values up to this number are broadcast with what they become.
BROADCAST_VALUES = 100_000


def resolved(df: DataFrame, source: DataFrame, column: str, f: Callable[[str], Column]) -> DataFrame:
    """``df`` with ``_resolved_<column>``: ``f`` of the column, computed once for each distinct value of it in ``source``.

    For costly functions of columns with few values, in tables that are cheap to read twice.
    """
    values = cut(source.select(column).where(F.col(column).isNotNull()).distinct())
    values = cut(values.select(F.col(column).alias("_value"), f(column).alias(f"_resolved_{column}")))
    few = values.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
    return df.join(F.broadcast(values) if few else values, F.col(column) == F.col("_value"), "left").drop("_value")


def _districts(df: DataFrame, source: DataFrame, stored: bool) -> tuple[DataFrame, Callable[[str], Column]]:
    """What districts are to be taken from, for ``apply``: the joined column if the source is stored, else the function itself."""
    if not stored or "district" not in df.columns:
        return df, C.district
    return resolved(df, source, "district", C.district), lambda c: F.col(f"_resolved_{c}")


def _first(df: DataFrame, source: DataFrame, stored: bool, key: str, *order: Column) -> DataFrame:
    """One row for each key. Rows of a stored table whose key is theirs alone aren't shuffled."""
    return first_of_few(df, source, key, *order) if stored else first_by_key(df, key, *order)


def seen(watch: Watch | None, df: DataFrame, lost: str | None = None) -> DataFrame:
    return df if watch is None else watch.at(df, lost)


def _unreadable(old: Column, new: Column) -> Column:
    return new.isNull()


def _outside(old: Column, new: Column) -> Column:
    return to_double(old).isNotNull() & new.isNull()


def _converted(old: Column, new: Column) -> Column:
    return new.isNotNull() & (old.cast("string") != new.cast("string"))


def _clamped(old: Column, new: Column) -> Column:
    return to_double(old) != new


def fill_province(df: DataFrame) -> DataFrame:
    if "district" not in df.columns:
        return df
    known = C.province_of("district")
    return df.withColumn("province", F.coalesce("province", known) if "province" in df.columns else known)


def gps_bounds(df: DataFrame) -> DataFrame:
    if {"gps_latitude", "gps_longitude"} <= set(df.columns):
        lat, lon = C.gps_pair("gps_latitude", "gps_longitude")
        return df.withColumns({"gps_latitude": lat, "gps_longitude": lon})
    return df


def consented(df: DataFrame, flag: str = "consent_given") -> DataFrame:
    """Rows with consent; without the column all rows pass."""
    return df.where(F.col(flag) == 1) if flag in df.columns else df


def clean_households(raw: DataFrame, watch: Watch | None = None, stored: bool = False) -> DataFrame:
    df = seen(watch, normal_headers(raw))
    df = seen(watch, df.na.drop(subset=["household_id"]), "missing_hh_id_dropped")
    if "submission_time" in df.columns:
        df, source = (x.withColumn("submission_time", C.parse_date("submission_time")) for x in (df, normal_headers(raw).na.drop(subset=["household_id"])))
        df = _first(df, source, stored, "household_id", F.col("submission_time").desc_nulls_last())
    number = lambda low, high: lambda c: null_outside(to_double(c), low, high)
    df, district = _districts(df, normal_headers(raw), stored)
    changes = {
        "district": district, "water_source": C.water_source, "ses_tier": C.ses_tier, "consent_given": C.yes_no, "has_toilet": C.yes_no,
        "enrollment_date": C.parse_date, "household_size": number(1, 25), "respondent_age": number(15, 65),
        "children_under_5": to_double, "women_15_49": to_double, "enumerator_id": C.enumerator_id,
    }
    if {"gps_latitude", "gps_longitude"} <= set(df.columns):
        lat, lon = C.gps_pair("gps_latitude", "gps_longitude")
        changes |= {"gps_latitude": lambda _: lat, "gps_longitude": lambda _: lon}
    df = apply(df, changes, watch, "duplicates_removed", {
        "district_normalised": ("district", C.changed), "water_source_normalised": ("water_source", C.changed), "ses_tier_normalised": ("ses_tier", C.changed),
        "bad_enrollment_dates": ("enrollment_date", _unreadable), "implausible_respondent_age": ("respondent_age", _outside),
        "implausible_hh_size": ("household_size", _outside), "gps_out_of_bounds_nulled": ("gps_latitude", _outside),
        "enum_id_standardised": ("enumerator_id", C.changed),
    })
    return seen(watch, consented(fill_province(df)), "no_consent_dropped").drop("_resolved_district")


def child_limits(df: DataFrame) -> DataFrame:
    """Children's measurements outside plausible bounds become NULL; other rows keep theirs."""
    child = F.coalesce(F.col("record_type") == "child", F.lit(False))
    return df.withColumns({c: F.when(~child | F.col(c).between(*b), F.col(c)) for c, b in CHILD_LIMITS.items() if c in df.columns})


def z_limits(df: DataFrame) -> DataFrame:
    return apply(df, {c: lambda c: F.when(F.abs(F.col(c)) <= 6, F.col(c)) for c in Z_SCORES})


def maternal_limits(df: DataFrame) -> DataFrame:
    """Age 10 to 60 for maternal rows, hemoglobin 3 to 20 for all."""
    maternal = F.coalesce(F.col("record_type") == "maternal", F.lit(False))
    return apply(df, {
        "maternal_age": lambda c: F.when(~maternal | F.col(c).between(10, 60), F.col(c)),
        "hemoglobin_gdl": lambda c: null_outside(c, 3.0, 20.0),
    })


def clean_visits(raw: DataFrame, watch: Watch | None = None, stored: bool = False) -> DataFrame:
    df = seen(watch, normal_headers(raw))
    df = seen(watch, df.na.drop(subset=["visit_id", "household_id"]), "missing_pk_dropped")
    df = _first(df, normal_headers(raw).na.drop(subset=["visit_id", "household_id"]), stored, "visit_id", *([F.col("_ingested_at").asc_nulls_last()] if "_ingested_at" in df.columns else []))
    df, district = _districts(df, normal_headers(raw), stored)
    changes = {"district": district, "visit_date": C.parse_date, "enumerator_id": C.enumerator_id} | dict.fromkeys(VISIT_FLAGS, C.yes_no) | dict.fromkeys(VISIT_NUMBERS, to_double)
    limits: dict[str, tuple[Column | None, float, float]] = {}
    if "record_type" in df.columns:
        of = lambda kind: F.coalesce(F.col("record_type") == kind, F.lit(False))
        limits = {c: (of("child"), *b) for c, b in CHILD_LIMITS.items()} | dict.fromkeys(Z_SCORES, (None, -6.0, 6.0))
        limits |= {"maternal_age": (of("maternal"), 10.0, 60.0), "hemoglobin_gdl": (None, 3.0, 20.0)}
    within = lambda which, low, high: lambda c: F.when((F.lit(False) if which is None else ~which) | to_double(c).between(low, high), to_double(c))
    changes |= {c: within(*b) for c, b in limits.items()}
    issues = {"district_normalised": ("district", C.changed), "bad_visit_dates": ("visit_date", _unreadable), "enum_id_standardised": ("enumerator_id", C.changed)}
    issues |= {f"{c}_converted": (c, _converted) for c in VISIT_FLAGS} | {f"implausible_{c.removesuffix('_gdl')}": (c, _outside) for c in limits}
    df = fill_province(apply(df, changes, watch, "duplicate_visit_ids", issues)).drop("_resolved_district")
    groups = {"child_age_months": ("child_age_group", C.child_age_group), "maternal_age": ("maternal_age_group", C.maternal_age_group)}
    return df.withColumns({name: f(c) for c, (name, f) in groups.items() if c in df.columns})


def clean_facilities(raw: DataFrame, watch: Watch | None = None, stored: bool = False) -> DataFrame:
    df = seen(watch, normal_headers(raw))
    df = _first(df.na.drop(subset=["assessment_id"]), normal_headers(raw).na.drop(subset=["assessment_id"]), stored, "assessment_id")
    score = lambda c: clamped(to_double(c), 0.0, 100.0)
    flags = ["has_electricity", "has_water", "has_toilet", *[c for c in df.columns if c.startswith("stockout_")]]
    df, district = _districts(df, normal_headers(raw), stored)
    changes = {"assessment_date": C.parse_date, "readiness_score": score, "overall_score": score, "district": district} | dict.fromkeys(flags, C.yes_no)
    return apply(df, changes, watch, "duplicates_dropped", {
        "bad_assessment_dates": ("assessment_date", _unreadable), "district_normalised": ("district", C.changed),
        "readiness_score_clamped": ("readiness_score", _clamped), "overall_score_clamped": ("overall_score", _clamped),
    }).drop("_resolved_district")


def clean_enumerator_log(raw: DataFrame, watch: Watch | None = None, stored: bool = False) -> DataFrame:
    changes = {
        "date": C.parse_date, "enumerator_id": C.enumerator_id, "submissions": to_double, "short_interviews": to_double,
        "flagged_for_backcheck": to_double, "avg_duration_min": lambda c: null_outside(to_double(c), 0, 480),
    }
    issues = {"bad_dates": ("date", _unreadable), "enum_id_standardised": ("enumerator_id", C.changed), "implausible_avg_duration_min": ("avg_duration_min", _outside)}
    return apply(normal_headers(raw), changes, watch, None, issues)


def clean_backchecks(raw: DataFrame, watch: Watch | None = None, stored: bool = False) -> DataFrame:
    df = seen(watch, normal_headers(raw))
    if "backcheck_id" in df.columns:
        df = _first(df, normal_headers(raw), stored, "backcheck_id")
    numbers = [f"{what}_{which}" for what in ("height", "weight") for which in ("original_cm", "recheck_cm", "original_kg", "recheck_kg", "discrepancy_cm", "discrepancy_kg")]
    changes = dict.fromkeys(numbers, to_double) | {"morbidity_match": C.yes_no, "overall_pass": C.yes_no, "backcheck_enumerator_id": C.enumerator_id}
    return apply(df, changes, watch, "duplicates_dropped", {"enum_id_standardised": ("backcheck_enumerator_id", C.changed)})


def clean_generic(raw: DataFrame, watch: Watch | None = None, stored: bool = False) -> DataFrame:
    """For datasets without a job of their own: headers, latest row of the first key, dates by name, bounds, labels."""
    named = rename_legacy(normal_headers(rename_legacy(raw), dots=True))
    df = seen(watch, named)
    key = next((k for k in KEYS if k in df.columns), None)
    if key:
        stamp = [F.col(c).desc_nulls_last() for c in ("_ingested_at", "submission_time") if c in df.columns]
        df = _first(df, named, stored, key, *stamp)
    dates = {c: C.parse_date for c in df.columns if any(x in c for x in ("date", "time", "period"))}
    permissive = lambda c: C.yes_no(c, permissive=True)
    df, district = _districts(df, named, stored)
    changes = dates | dict.fromkeys(GENERIC_FLAGS, permissive) | {
        "gps_latitude": C.gps_latitude, "latitude": C.gps_latitude, "ses_tier": C.legacy_ses_tier, "water_source": C.legacy_water_source,
        "muac_mm": C.muac_mm, "district": district,
    }
    return fill_province(apply(df, changes, watch, "duplicates_removed", {"district_normalised": ("district", C.changed)})).drop("_resolved_district")


JOBS: dict[str, Callable[[DataFrame, Watch | None, bool], DataFrame]] = {
    "households": clean_households, "followup_visits": clean_visits, "facility_assessments": clean_facilities,
    "enumerator_performance": clean_enumerator_log, "backcheck_records": clean_backchecks,
}


def clean(name: str, raw: DataFrame, watch: Watch | None = None, stored: bool = False) -> DataFrame:
    """The dataset's job on its rows without their lineage; the order of input tells repeated keys apart.

    ``stored``: the rows are those of a table, so each spelling of a district is resolved once, in a pass over its column.
    """
    return JOBS.get(name, clean_generic)(raw.drop(*LINEAGE), watch, stored).drop(INPUT_ORDER)


CDC = ("_cdc_op", "_cdc_ts", "_cdc_source")


def key_of(df: DataFrame) -> str | None:
    return next((k for k in KEYS if k in df.columns), None)


def newest_load(raw: DataFrame) -> DataFrame:
    """Of the rows with one key those of its last load, as a changed source is appended whole.

    A dataset without a key has the rows of the last load of each source file. A table of one load is returned as it is.
    """
    if "_ingested_at" not in raw.columns:
        return raw
    ends = raw.agg(F.min("_ingested_at"), F.max("_ingested_at")).first()
    if ends[0] == ends[1]:
        return raw
    names = {}
    for c in raw.columns:
        plain = c.strip().lower().replace(" ", "_")
        names.setdefault(refdata.LEGACY_HEADERS.get(plain, plain), c)
    key = next((names[k] for k in KEYS if k in names), "_source_file")
    last = raw.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max("_ingested_at").alias("_last"))
    both = raw.join(last, F.col(f"`{key}`") == F.col("_key"), "left")
    return both.where(F.col("_last").isNull() | (F.col("_ingested_at") == F.col("_last"))).drop("_key", "_last")


def build(bronze: Mapping[str, DataFrame], now: str, previous: Mapping[str, DataFrame] | None = None, watches: dict[str, Watch] | None = None) -> dict[str, DataFrame]:
    """All datasets cleaned and tagged by key against the previous tables.

    Rows of new keys are INSERT, rows that differ UPDATE; rows that are the same keep their tags. Without a
    previous table all rows are INSERT; without a key all are UPDATE. Keys that have gone are in ``changes``.
    ``watches`` gets a watch for each dataset, to be asked when the table has been written.
    """
    out = {}
    for name, raw in bronze.items():
        before = (previous or {}).get(name)
        watch = None
        if watches is not None:
            watch = watches[name] = Watch()
        df = clean(name, newest_load(raw), watch, stored=True)
        key = key_of(df)
        if before is None or key is None or key not in before.columns:
            out[name] = tag_changes(df, "INSERT" if before is None else "UPDATE", name, now)
            continue
        common = [c for c in df.columns if c in before.columns and c not in CDC]
        old = first_by_key(before.where(F.col(key).isNotNull()), key)
        old = old.select(F.col(key).alias("_key"), row_hash(old.select(*common), [key]).alias("_old"), F.col("_cdc_op").alias("_op"), F.col("_cdc_ts").alias("_ts"))
        both = df.withColumn("_new", row_hash(df.select(*common), [key])).join(old, F.col(key) == F.col("_key"), "left")
        op = F.when(F.col("_old").isNull(), "INSERT").when(F.col("_old") != F.col("_new"), "UPDATE")
        tagged = tag_changes(both, F.coalesce(op, F.col("_op")), name, now)
        out[name] = tagged.withColumn("_cdc_ts", F.when(op.isNull(), F.col("_ts")).otherwise(F.col("_cdc_ts"))).drop("_key", "_old", "_new", "_op", "_ts")
    return out


def changes(before: DataFrame | None, after: DataFrame) -> DataFrame | None:
    """``key, _cdc_op`` (INSERT, UPDATE or DELETE) of every key that differs between two versions; None without a key."""
    key = key_of(after)
    if key is None or (before is not None and key not in before.columns):
        return None
    one = lambda df: first_by_key(df.drop(*CDC).where(F.col(key).isNotNull()), key)
    if before is None:  # keys alone tell all
        return after.select(key).where(F.col(key).isNotNull()).distinct().select(F.col(key).cast("string").alias("key"), F.lit("INSERT").alias("_cdc_op"))
    return snapshot_diff(one(before), one(after), key).select(F.col(key).cast("string").alias("key"), "_cdc_op")

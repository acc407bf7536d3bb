"""Cleaning of survey fields as native column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarisk.functions import refdata
from tamarisk.functions.numeric import col, to_double


def stripped(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c).cast("string"), r"^\s+|\s+$", "")


def lookup(key: Column, values: Mapping[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def yes_no(c: Column | str, permissive: bool = False) -> Column:
    """1, 0 or NULL. Numbers are truncated: strict gives 1 for any but zero, permissive the number itself."""
    text = F.lower(stripped(c))
    number = text.try_cast("double")
    whole = F.when((number > -9.0e15) & (number < 9.0e15), number.cast("long"))
    other = whole if permissive else F.when(whole != 0, 1).when(whole == 0, 0)
    yes, no = refdata.YES + refdata.YES_MORE * permissive, refdata.NO + refdata.NO_MORE * permissive
    return F.when(text.isin(*yes), 1).when(text.isin(*no), 0).otherwise(other).cast("int")


def title_case(c: Column | str) -> Column:
    """Every run of letters with a capital first letter (``R.Y.KHAN`` gives ``R.Y.Khan``)."""
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def district(c: Column | str) -> Column:
    """Canonical district: known variant, then canonical name, then the first district that contains
    the value or lies in it, else the value in title case. Blank values are NULL."""
    text = stripped(c)
    low = F.lower(text)
    known = refdata.DISTRICT_VARIANTS | {name.lower(): name for name, *_ in refdata.DISTRICTS}

    def spelled(low: Column) -> Column:
        return F.coalesce(*[F.when(F.contains(F.lit(name.lower()), low) | F.contains(low, F.lit(name.lower())), name) for name, *_ in refdata.DISTRICTS])

    part = F.transform(F.array(low), spelled)[0]  # so that each test has the text at hand and doesn't make it anew
    return F.when(text != "", F.coalesce(lookup(low, known), part, title_case(text)))


def province_of(district_name: Column | str) -> Column:
    return lookup(col(district_name), refdata.PROVINCE_OF)


def label(c: Column | str, *maps: Mapping[str, str]) -> Column:
    """Lower-case label, translated by the first map that knows it."""
    text = stripped(c)
    low = F.lower(text)
    return F.coalesce(*[lookup(low, m) for m in maps], low)


def water_source(c: Column | str) -> Column:
    return label(c, refdata.WATER_URDU)


def ses_tier(c: Column | str) -> Column:
    return label(c, refdata.SES_URDU)


def legacy_water_source(c: Column | str) -> Column:
    return label(c, refdata.WATER_LEGACY)


def legacy_ses_tier(c: Column | str) -> Column:
    return label(c, refdata.SES_LEGACY)


_DAY, _MONTH, _YEAR = "0*(?:3[01]|[12][0-9]|[1-9])", "0*(?:1[0-2]|[1-9])", "[+-]?[0-9]{4,}"
#: Day and month may lack the leading zero; the first pattern that fits decides.
DATE_PATTERNS = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy", "yyyy/M/d", "d.M.yyyy")


def _may_fit(text: Column, pattern: str) -> Column:
    """Whether the text has the shape of the pattern. What has it not can't be parsed by it, which costs an exception to find out."""
    shape = pattern.replace(".", "[.]").replace("yyyy", "Y").replace("d", "D").replace("Y", _YEAR).replace("D", _DAY).replace("M", _MONTH)
    return text.rlike(f"^{shape}$")


def parse_date(c: Column | str) -> Column:
    """Timestamp of the first pattern that fits, then of any ISO form, else NULL."""
    text = stripped(c)
    return F.coalesce(*[F.when(_may_fit(text, p), F.try_to_timestamp(text, F.lit(p))) for p in DATE_PATTERNS], text.try_cast("timestamp"))


def enumerator_id(c: Column | str) -> Column:
    """``E`` and three digits at least for e001, ENU001 and the like; other values as they are, trimmed."""
    text = stripped(c)
    digits = F.regexp_extract(text, r"[Ee](?:[Nn][Uu]?)?(\d+)", 1)
    number = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(digits != "", F.concat(F.lit("E"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))).otherwise(text)


def gps_pair(lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    """Both coordinates, or two NULLs if a latitude is there and one of the pair lies outside the country or is missing."""
    lat, lon = to_double(lat), to_double(lon)
    inside = lat.between(23.5, 37.5) & lon.between(60.5, 77.5)
    kept = lat.isNull() | F.coalesce(inside, F.lit(False))
    return F.when(kept, lat), F.when(kept, lon)


def gps_latitude(c: Column | str) -> Column:
    lat = to_double(c)
    return F.when(lat.between(23.5, 37.5), lat)


def muac_mm(c: Column | str) -> Column:
    """Arm circumference in millimetres; values below 30 were taken in centimetres."""
    value = to_double(c)
    return F.when(value < 30, value * 10).otherwise(value)


def binned(c: Column | str, edges: Iterable[float], labels: Iterable[str]) -> Column:
    """Label of the half-open interval (edge, next edge] that holds the value, else NULL."""
    edges, out = list(edges), F
    for low, high, name in zip(edges, edges[1:], labels, strict=False):
        out = out.when((col(c) > low) & (col(c) <= high), name)
    return out


def child_age_group(c: Column | str) -> Column:
    return binned(c, (-1, 5, 11, 23, 35, 59), ("0-5m", "6-11m", "12-23m", "24-35m", "36-59m"))


def maternal_age_group(c: Column | str) -> Column:
    return binned(c, (14, 19, 24, 29, 34, 49), ("15-19", "20-24", "25-29", "30-34", "35-49"))


def null_sentinel(c: Column | str) -> Column:
    """Texts that stand for a missing value become NULL."""
    return F.when(~col(c).isin("None", "nan", "<NA>"), col(c))


def bilingual(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string").rlike("|".join(refdata.URDU_WORDS)), F.lit(False))


def changed(before: Column | str, after: Column | str) -> Column:
    """Whether cleaning altered the value; NULL and the empty text are the same."""
    return F.coalesce(col(before).cast("string"), F.lit("")) != F.coalesce(col(after).cast("string"), F.lit(""))

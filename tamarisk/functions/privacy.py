"""Pseudonyms, bands and masks for personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarisk.functions.numeric import col


def pseudonym(name: Column | str, salt: str) -> Column:
    """``ID_`` and eight hexadecimal digits of the salted SHA-256; missing names are ``UNKNOWN``."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), col(name)), 256)
    return F.when(F.coalesce(col(name), F.lit("")) == "", "UNKNOWN").otherwise(F.concat(F.lit("ID_"), F.upper(F.substring(digest, 1, 8))))


def age_band(age: Column | str, size: int = 5) -> Column:
    """``25-29``; NULL stays NULL."""
    low = (F.floor(col(age) / size) * size).cast("int")
    return F.concat(low.cast("string"), F.lit("-"), (low + size - 1).cast("string"))


def masked_gps(c: Column | str, digits: int = 2) -> Column:
    return F.round(col(c), digits)

"""Personal data, audit and codebook."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions.privacy import pseudonym
from tamarisk.operators.serving import PERSONAL

AUDIT = "at timestamp, user string, action string, table string, row_count long"


def strip_personal(df: DataFrame, salt: str, keep_pseudonym: bool = True) -> DataFrame:
    """Names become pseudonyms (or go), other personal columns go."""
    have = [c for c in PERSONAL if c in df.columns]
    names = [c for c in have if c.endswith("_name")] if keep_pseudonym else []
    return df.withColumns({c: pseudonym(c, salt) for c in names}).drop(*[c for c in have if c not in names])


def audit_record(spark: SparkSession, user: str, action: str, table: str, row_count: int, now: str) -> DataFrame:
    """One row for the audit table."""
    values = {"at": F.lit(now).cast("timestamp"), "user": F.lit(user), "action": F.lit(action), "table": F.lit(table), "row_count": F.lit(row_count).cast("long")}
    return spark.range(1).select(*[c.alias(k) for k, c in values.items()])


def codebook(df: DataFrame, dataset: str, descriptions: dict[str, str] | None = None, personal: Sequence[str] = PERSONAL, exact: bool = False) -> DataFrame:
    """``dataset, field, type, pii, description, missing_pct, n_distinct, minimum, maximum``: metadata and a profile in one pass.

    Distinct values are estimated unless ``exact``, which shuffles all of them.
    """
    names = df.columns
    distinct = F.count_distinct if exact else F.approx_count_distinct
    stats = F.array(*[
        F.struct(
            F.lit(c).alias("field"), F.lit(kind).alias("type"), F.lit("YES" if c in personal else "no").alias("pii"),
            F.lit((descriptions or {}).get(c)).cast("string").alias("description"),
            F.round(100 * F.avg(F.col(c).isNull().cast("int")), 1).alias("missing_pct"), distinct(c).alias("n_distinct"),
            F.min(c).cast("string").alias("minimum"), F.max(c).cast("string").alias("maximum"),
        )
        for c, kind in df.select(*names).dtypes
    ])
    return df.agg(stats.alias("s")).select(F.lit(dataset).alias("dataset"), F.explode("s").alias("s")).select("dataset", "s.*")

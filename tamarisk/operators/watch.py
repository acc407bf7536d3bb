"""Counts of what a job does to its rows, taken while its result is written, without a pass of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FIXES = "dataset string, issue string, n long"


class Watch:
    """Points in a job at which rows are counted as they pass.

    Spark may compute rows again after it has lost an executor, and then they pass a point twice. So the rows
    counted at the last point are held against those written, and at the first point against those read; if
    either differs, the points are counted again by aggregation.
    """

    def __init__(self) -> None:
        self._points: list[tuple[Observation, DataFrame, str | None, dict[str, Column]]] = []

    def at(self, df: DataFrame, lost: str | None = None, **issues: Column) -> DataFrame:
        """A point: rows for which each of the conditions holds are counted, and as ``lost`` those gone since the point before."""
        seen = Observation()
        self._points.append((seen, df, lost, issues))
        return df.observe(seen, F.count("*").alias("rows"), *_counts(issues))

    def counts(self, written: int, read: int | None = None) -> dict[str, int]:
        """Rows by issue. To be called when the result has been written."""
        if not self._points:
            return {}
        found = [seen.get for seen, *_ in self._points]
        if read is None:
            read = self._points[0][1].count()
        if found[-1]["rows"] != written or found[0]["rows"] != read:
            found = [df.agg(F.count("*").alias("rows"), *_counts(issues)).first().asDict() for _, df, _, issues in self._points]
        out: dict[str, int] = {}
        for i, (_, _, lost, issues) in enumerate(self._points):
            if lost:
                out[lost] = found[i - 1]["rows"] - found[i]["rows"]
            out |= {k: found[i][k] for k in issues}
        return out


def _counts(issues: dict[str, Column]) -> list[Column]:
    return [F.count_if(x).alias(k) for k, x in issues.items()]


def table_of(spark: SparkSession, fixes: Sequence[tuple[str, str, int]]) -> DataFrame:
    """``dataset, issue, n``: a row for each issue that a job looks for."""
    return spark.createDataFrame(list(fixes), FIXES)

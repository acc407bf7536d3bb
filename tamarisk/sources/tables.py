"""JDBC tables: load and upsert."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MODES = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}


def load(df: DataFrame, url: str, table: str, if_exists: str = "append", batch_size: int = 1000, partitions: int = 8, properties: Mapping[str, str] | None = None) -> int:
    """Writes the rows in batches over a bounded number of connections; returns their number (0: nothing is written)."""
    if df.isEmpty():
        return 0
    seen = Observation()
    rows = df.observe(seen, F.count("*").alias("n"))
    rows.write.mode(MODES[if_exists]).option("batchsize", batch_size).option("numPartitions", partitions).jdbc(url, table, properties=dict(properties or {}))
    return seen.get["n"]


def read(spark: SparkSession, url: str, table: str, column: str | None = None, partitions: int = 8, properties: Mapping[str, str] | None = None) -> DataFrame:
    """A table; with a numeric or date ``column`` over so many connections, each with a range of it between its least and greatest value."""
    properties = dict(properties or {})
    if column is None:
        return spark.read.jdbc(url, table, properties=properties)
    ends = spark.read.jdbc(url, f'(SELECT min("{column}") AS "low", max("{column}") AS "high" FROM {table}) ends', properties=properties).first()
    if ends["low"] is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, f'"{column}"', str(ends["low"]), str(ends["high"]), partitions, properties=properties)


def statement(spark: SparkSession, url: str, *commands: str) -> None:
    """Runs SQL commands in one transaction on the driver's connection."""
    link = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        link.setAutoCommit(False)
        for command in commands:
            run = link.createStatement()
            run.executeUpdate(command)
            run.close()
        link.commit()
    except Exception:
        link.rollback()
        raise
    finally:
        link.close()


def upsert(df: DataFrame, url: str, table: str, key: str, order: str | None = None, staging: str | None = None) -> int:
    """Rows of known keys replace the old ones, others are added; no other row is touched.

    The rows are staged in a table of their own; the database then deletes the old rows and
    inserts the new ones in one transaction. Of rows with the same key the last by ``order``
    counts. Returns the number of staged rows.
    """
    from tamarisk.operators.scd import latest_by_key

    staging = staging or f"{table}_staging"
    n = load(latest_by_key(df, key, order), url, staging, "replace")
    if n:
        names = ", ".join(f'"{c}"' for c in df.columns)
        statement(
            df.sparkSession, url,
            f'DELETE FROM {table} WHERE "{key}" IN (SELECT "{key}" FROM {staging})',
            f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}",
        )
    return n


def publish(tables: Mapping[str, DataFrame], url: str) -> dict[str, int]:
    """Report tables to the warehouse in replace mode, without the layer column."""
    return {name: load(df.drop("_layer"), url, name, "replace") for name, df in tables.items()}

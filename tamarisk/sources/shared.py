"""The shared folder of the session, lineage cut through it, and how much a task takes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the context's own folder.

    Only a local session (tests) gets a temporary folder where none is set; on a cluster
    executors would write where the driver can't read, so that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: What a task takes of files and of shuffles; in sorts and hash tables rows take 10 to 50 times these bytes.
TASK_BYTES = {"spark.sql.files.maxPartitionBytes": 32 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20}


def small_tasks(spark: SparkSession) -> None:
    """Cuts the work into more tasks than Spark does by itself, so that none needs much memory. What the session sets is left alone."""
    for name, size in TASK_BYTES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(size))

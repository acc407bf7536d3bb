"""Structured Streaming over landed survey submissions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tamarisk.functions.cleaning import parse_date, yes_no
from tamarisk.functions.numeric import to_double
from tamarisk.operators import scd
from tamarisk.sources import files

#: A landed form, as text.
FORM = (
    "household_id string, province string, district string, union_council string, respondent_name string, respondent_age string, "
    "household_size string, children_under_5 string, water_source string, ses_tier string, has_toilet string, consent_given string, "
    "gps_raw string, submission_time string"
)
REQUIRED = ("household_id", "district", "respondent_name", "respondent_age", "household_size")
LIMITS = {"respondent_age": (15, 90), "household_size": (1, 30), "children_under_5": (0, 10)}


def landed(spark: SparkSession, path: str, schema: StructType | str = FORM, files_per_trigger: int | None = None) -> DataFrame:
    """Each landed JSON file once."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def typed(forms: DataFrame) -> DataFrame:
    """Typed submissions: flags, numbers, time, and the two coordinates of ``"lat, lon"``."""
    parts = F.split(F.coalesce("gps_raw", F.lit("")), ",")
    whole = lambda c: to_double(c).cast("int")
    return forms.withColumns({
        "has_toilet": yes_no("has_toilet"), "consent_given": F.coalesce(yes_no("consent_given"), F.lit(0)),
        "respondent_age": whole("respondent_age"), "household_size": whole("household_size"),
        "children_under_5": F.coalesce(whole("children_under_5"), F.lit(0)), "submission_time": parse_date("submission_time"),
        "gps_latitude": to_double(F.trim(F.get(parts, F.lit(0)))), "gps_longitude": to_double(F.trim(F.get(parts, F.lit(1)))),
        "data_source": F.lit("web_form"),
    })


def validated(df: DataFrame) -> DataFrame:
    """Adds ``errors``: the fields that are missing or out of bounds, sorted as checked."""
    checks = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"{c} missing") for c in REQUIRED]
    checks += [F.when(~to_double(c).between(*b), f"{c} out of range") for c, b in LIMITS.items()]
    return df.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull()))


def split_valid(valid_path: str, quarantine_path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes valid rows and rows with errors to their folders.

    Each batch has a folder of its own there (``batch_id``), which a batch that is run again replaces.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch.where(F.size("errors") == 0).drop("errors").write.mode("overwrite").parquet(f"{valid_path}/batch_id={batch_id}")
            batch.where(F.size("errors") > 0).write.mode("overwrite").parquet(f"{quarantine_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write


def first_arrivals(df: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The first row of each key within the delay."""
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def daily_counts(df: DataFrame, at: str, key: str, delay: str, counted: str) -> DataFrame:
    """Rows and distinct ids (NULL isn't one) by day and group; days close when the delay has passed.

    Ids are told apart by one aggregation, whose state is spread by id, and counted by the next, which
    gets a row for each id of a closed day.
    """
    each = df.withWatermark(at, delay).groupBy(F.window(at, "1 day").alias("day"), key, counted).agg(F.count("*").alias("rows"))
    found = each.groupBy(F.window(F.window_time("day"), "1 day"), key).agg(F.sum("rows").alias("n"), F.count(counted).alias("n_distinct"))
    return found.select(F.col("window.start").alias("day"), key, "n", "n_distinct")


def sliding_rate(df: DataFrame, at: str, key: str, value: str, delay: str, width: str = "30 days", step: str = "1 day") -> DataFrame:
    """Rows and mean value by group over a window that moves by steps.

    Rows are summed up by step first; only these sums are copied into the windows that hold them.
    """
    panes = df.withWatermark(at, delay).groupBy(F.window(at, step).alias("pane"), key)
    panes = panes.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.count(value).alias("known"))
    found = panes.groupBy(F.window(F.window_time("pane"), width, step), key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("known").alias("known"))
    return found.select(F.col("window.end").alias("until"), key, "n", F.try_divide("total", "known").alias("rate"))


def short_interviews(df: DataFrame, minutes: str = "interview_duration_min", limit: float = 10) -> DataFrame:
    return df.where(F.col(minutes) < limit)


#: Bytes of a bucket's files beyond which it is split.
BUCKET_BYTES = 256 << 20
#: Files of a bucket in a version, at least (or its rows, if fewer), so that many tasks share a batch of few buckets; a file has so many new rows and copied bytes, about.
LEAST_FILES, FILE_ROWS, FILE_BYTES = 4, 1_000_000, 64 << 20


def upsert_batches(path: str, key: str, order: str, source: str, now: str, buckets: int = 32, bucket_bytes: int = BUCKET_BYTES) -> Callable[[DataFrame, int], None]:
    """A batch function that merges each batch into the table of a folder; the last row of a key by ``order``
    counts, also when files arrive out of order.

    The table is cut into buckets by key, at first ``buckets`` (a power of two) of them. A batch writes the buckets
    that it touches as a new version beside the old ones, so its cost grows with these, a batch that is run again
    gives the same table, and readers never see half of one. A bucket that has grown beyond ``bucket_bytes`` is
    written as two, by one more bit of its keys' hash, so what a batch writes for a key doesn't grow with the
    table. What two later versions of a bucket stand above is removed.
    """
    depth = buckets.bit_length() - 1
    if buckets != 1 << depth:
        raise ValueError("the number of buckets is a power of two")
    start = {f"{depth}-{v}" for v in range(buckets)}

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = bucket_versions(spark, path, batch_id)
        leaves = {b: held[b][-1] if b in held else None for b in _unsplit(start | set(held), depth)}
        rows = _in_buckets(scd.latest_by_key(batch, key, order), key, set(leaves)).persist()
        try:
            touched = {r["key_bucket"] for r in rows.select("key_bucket").distinct().collect()}  # a row for each bucket at most
            old = current_version(spark, path, batch_id, touched)
            if old is None:
                out = scd.tag_changes(rows.drop("key_bucket"), "INSERT", source, now)
            else:
                known = old.select(key, F.col(order).alias("_known"))
                newer = rows.drop("key_bucket").join(known, key, "left").where(F.col("_known").isNull() | (F.col(order) >= F.col("_known"))).drop("_known")
                out = scd.upsert(old, scd.tag_against(old, newer, key, source, now), key, order)
            sizes = {b: files.size_of(spark, _bucket_path(path, leaves[b], b)) for b in touched if leaves[b] is not None}
            large = {b for b, size in sizes.items() if size > bucket_bytes}
            after = {*leaves} - large | {half for b in large for half in _halves(b)}
            # Each bucket is gathered first, in as many parts as it has work for; else every task would write a file for every bucket.
            files_of = LEAST_FILES + rows.count() // (FILE_ROWS * max(1, len(touched))) + max(sizes.values(), default=0) // FILE_BYTES
            gathered = _in_buckets(out, key, after).repartition(max(1, len(touched) + len(large)) * files_of, "key_bucket", F.pmod(F.hash(key), F.lit(files_of)))
            gathered.write.mode("overwrite").partitionBy("key_bucket").parquet(files.version_path(path, batch_id))
        finally:
            rows.unpersist()
        held = bucket_versions(spark, path)
        for b, numbers in held.items():
            later = {n for other, found in held.items() if other == b or b in _around(other) for n in found}
            for number in numbers:
                if sum(n > number for n in later) >= 2:
                    files.remove(spark, _bucket_path(path, number, b))

    return merge


def _bucket_path(path: str, number: int, bucket: str) -> str:
    return f"{files.version_path(path, number)}/key_bucket={bucket}"


def _halves(bucket: str) -> tuple[str, str]:
    """A bucket ``depth-value`` has the keys whose hash ends in the ``depth`` bits of ``value``."""
    depth, value = map(int, bucket.split("-"))
    return f"{depth + 1}-{value}", f"{depth + 1}-{value + (1 << depth)}"


def _around(bucket: str) -> set[str]:
    """The wider buckets that hold all keys of this one."""
    depth, value = map(int, bucket.split("-"))
    return {f"{d}-{value % (1 << d)}" for d in range(depth)}


def _unsplit(buckets: set[str], depth: int) -> set[str]:
    """Buckets that together hold each key once: those that aren't split, and empty halves that were never written."""
    split = {wider for b in buckets for wider in _around(b)}
    return {half for b in split if int(b.split("-")[0]) >= depth for half in _halves(b)} - split | (buckets - split)


def _leaves(held: dict[str, list[int]]) -> dict[str, int]:
    """The buckets that weren't split, with their newest version; the keys of one that was are all in narrower ones."""
    split = {wider for b in held for wider in _around(b)}
    return {b: numbers[-1] for b, numbers in held.items() if b not in split}


def _in_buckets(df: DataFrame, key: str, buckets: set[str]) -> DataFrame:
    """The rows with the ``key_bucket`` that they belong to."""
    depths = sorted({int(b.split("-")[0]) for b in buckets})
    end = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    names = [F.concat(F.lit(f"{d}-"), (end % F.lit(1 << d)).cast("string")) for d in depths]
    if len(names) == 1:
        return df.withColumn("key_bucket", names[0])
    known = df.sparkSession.createDataFrame([(b,) for b in sorted(buckets)], "key_bucket string")  # a name for each bucket
    return df.withColumn("key_bucket", F.explode(F.array(*names))).join(F.broadcast(known), "key_bucket", "left_semi")


def bucket_versions(spark: SparkSession, path: str, before: int | None = None) -> dict[str, list[int]]:
    """The complete versions (older than ``before``, if given) that hold each bucket, oldest first."""
    found: dict[str, list[int]] = {}
    for number in files.versions(spark, path):
        if before is None or number < before:
            for name in files.folders(spark, files.version_path(path, number)):
                if name.startswith("key_bucket="):
                    found.setdefault(name.split("=")[1], []).append(number)
    return found


def current_version(spark: SparkSession, path: str, before: int | None = None, buckets: set[str] | None = None) -> DataFrame | None:
    """The newest complete version of each bucket (of those named), older than ``before``, if given."""
    found = _leaves(bucket_versions(spark, path, before))
    paths = [_bucket_path(path, number, b) for b, number in sorted(found.items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def run_to_end(writer: DataStreamWriter, checkpoint: str) -> None:
    """Processes all that has landed, then stops."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

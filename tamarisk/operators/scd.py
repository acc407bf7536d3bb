"""Merges by key: latest rows, upsert, slowly changing dimensions, change capture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.sources.shared import cut, small_tasks

#: Column with a row's place in the files that it was read from.
INPUT_ORDER = "_input_order"


def first_by_key(df: DataFrame, keys: str | Sequence[str], *order: Column | str) -> DataFrame:
    """One row for each key, the first in the order given, then in the order of input if the rows have it; others that tie are told apart by all their columns.

    Spark keeps one row of each key and task before the shuffle, so that a key with very many rows (or
    none, where it is NULL) doesn't gather them in one task.
    """
    small_tasks(df.sparkSession)
    keys = [keys] if isinstance(keys, str) else list(keys)
    read = [F.col(INPUT_ORDER).asc_nulls_last()] if INPUT_ORDER in df.columns else []
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    window = Window.partitionBy(*keys).orderBy(*order, *read, tie)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


#: Keys that repeat, up to this number, are broadcast with the place of their first row.
BROADCAST_KEYS = 100_000


def first_of_few(df: DataFrame, source: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """``first_by_key`` of rows of which few have a key in common: only the keys of all rows are shuffled.

    ``source`` has the rows of ``df`` and is cheap to read again: once for the keys that repeat, and once for the place
    of their first rows. Where many keys repeat, or rows of one key are alike in every column, all rows are put in order.
    """
    repeats = cut(source.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key")))
    n = repeats.limit(BROADCAST_KEYS + 1).count()
    if n == 0:
        return df
    if n > BROADCAST_KEYS:
        return first_by_key(df, key, *order)
    place = F.struct(*([INPUT_ORDER] if INPUT_ORDER in df.columns else []), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("tie"))
    rows = source.join(F.broadcast(repeats), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    if not rows.groupBy(key, place.alias("_place")).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        return first_by_key(df, key, *order)
    first = cut(first_by_key(rows, key, *order).select(F.col(key).alias("_key"), place.alias("_place")))
    both = df.join(F.broadcast(first), F.col(key).eqNullSafe(F.col("_key")), "left")
    return both.where(F.col("_place").isNull() | (F.col("_place") == place)).drop("_key", "_place")


def latest_by_key(df: DataFrame, keys: str | Sequence[str], order: str | None) -> DataFrame:
    return first_by_key(df, keys, *([F.col(order).desc_nulls_last()] if order else []))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``existing`` whose key is not incoming, and the incoming rows in its columns.

    Of incoming rows with the same key the last by ``order`` counts. Rows without a key are appended.
    """
    incoming = latest_by_key(incoming.where(F.col(key).isNotNull()), key, order).unionByName(incoming.where(F.col(key).isNull()))
    kept = existing.join(incoming.select(key).distinct(), key, "left_anti")
    have = [c for c in existing.columns if c in incoming.columns]
    return kept.select(*existing.columns).unionByName(incoming.select(*have), allowMissingColumns=True)


def upsert_stats(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """One row: ``inserts, updates, unchanged`` in keys; a matched key counts as an update."""
    old = existing.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_old", F.lit(1))
    new = incoming.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_new", F.lit(1))
    both = old.join(new, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_old").isNull()).alias("inserts"),
        F.count_if(F.col("_old").isNotNull() & F.col("_new").isNotNull()).alias("updates"),
        F.count_if(F.col("_new").isNull()).alias("unchanged"),
    )


SCD_COLUMNS = ("_scd_effective_from", "_scd_effective_to", "_scd_is_current", "_scd_version")


def initial_versions(df: DataFrame, effective_from: str = "2020-01-01") -> DataFrame:
    """Version 1 of every row, in force from a date on."""
    return df.withColumns({
        "_scd_effective_from": F.lit(effective_from), "_scd_effective_to": F.lit(None).cast("string"),
        "_scd_is_current": F.lit(True), "_scd_version": F.lit(1),
    })


def apply_scd2(existing: DataFrame, incoming: DataFrame, key: str, tracked: Sequence[str], now: str) -> DataFrame:
    """Type 2 merge with full history.

    New keys get version 1. If a tracked column differs from the current version (NULLs are
    equal to each other), that version ends ``now`` and the next one starts. Everything else
    stays, past versions included; a key whose versions have all ended goes on after the last.
    """
    fresh = latest_by_key(incoming, key, None)
    values = [c for c in existing.columns if c not in SCD_COLUMNS]
    last = existing.groupBy(key).agg(F.max("_scd_version").alias("_last"))
    current = existing.where("_scd_is_current").select(key, *[F.col(c).alias(f"_was_{c}") for c in tracked], F.lit(True).alias("_known"))
    judged = fresh.join(current, key, "left").join(last, key, "left")
    differs = F.lit(False)
    for c in tracked:
        differs = differs | ~F.col(c).cast("string").eqNullSafe(F.col(f"_was_{c}").cast("string"))
    starting = judged.where(F.col("_known").isNull() | differs)
    have = [c for c in values if c in fresh.columns]
    added = starting.select(
        *have,
        F.lit(now).alias("_scd_effective_from"),
        F.lit(None).cast("string").alias("_scd_effective_to"),
        F.lit(True).alias("_scd_is_current"),
        (F.coalesce("_last", F.lit(0)) + 1).cast("int").alias("_scd_version"),
    )
    ended = starting.where("_known").select(key, F.lit(True).alias("_ends"))
    old = existing.join(ended, key, "left").withColumn("_ends", F.coalesce("_ends", F.lit(False)) & F.col("_scd_is_current"))
    old = old.withColumns({
        "_scd_effective_to": F.when(F.col("_ends"), F.lit(now)).otherwise(F.col("_scd_effective_to")),
        "_scd_is_current": F.col("_scd_is_current") & ~F.col("_ends"),
    })
    return old.select(*existing.columns).unionByName(added, allowMissingColumns=True)


#: Facts of one key that one task puts in order, about.
FACTS_OF_KEY = 1_000_000


def as_of(facts: DataFrame, dimension: DataFrame, key: str, at: str, facts_of_key: int = FACTS_OF_KEY) -> DataFrame:
    """Each fact with the dimension version in force at its time; facts without one keep NULLs.

    Facts and versions of a key are put in order of time together, and each fact takes the last version before it,
    so a key with many versions and many facts costs their sum, not their product. Facts of a key that has more than
    ``facts_of_key`` of them are dealt over several parts, each with all versions of the key. Versions of a key
    don't overlap; of those that start together the one with the highest number counts.
    """
    have = [c for c in dimension.columns if c != key]
    # Keys with that many facts are few: one at most for each ``facts_of_key`` rows.
    many = facts.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > facts_of_key)
    many = F.broadcast(many.select("_key", F.ceil(F.col("_n") / facts_of_key).cast("int").alias("_parts")))
    dealt = facts.select(F.col(key).alias("_key"), F.col(at).cast("string").alias("_t"), F.struct(*facts.columns).alias("_fact"))
    part = F.coalesce(F.pmod(F.xxhash64("_fact"), F.col("_parts")), F.lit(0).cast("long"))
    dealt = dealt.alias("f").join(many.alias("m"), F.col("f._key").eqNullSafe(F.col("m._key")), "left").select("f._key", part.alias("_part"), "_t", "_fact")
    versions = dimension.where(F.col(key).isNotNull() & F.col("_scd_effective_from").isNotNull())
    versions = versions.select(F.col(key).alias("_key"), F.col("_scd_effective_from").cast("string").alias("_t"), F.struct(*have).alias("_version"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)).cast("long") - 1))
    versions = versions.alias("v").join(many.alias("m"), F.col("v._key") == F.col("m._key"), "left").select("v._key", parts.alias("_part"), "_t", "_version")
    both = dealt.unionByName(versions, allowMissingColumns=True)
    number = F.col("_version._scd_version") if "_scd_version" in have else F.lit(None)
    order = Window.partitionBy("_key", "_part").orderBy("_t", F.col("_fact").isNotNull(), number).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_version", ignorenulls=True).over(order)).where(F.col("_fact").isNotNull())
    ends = F.col("_last._scd_effective_to")
    in_force = F.when(F.col("_key").isNotNull() & (ends.isNull() | (F.col("_t") < ends)), F.col("_last"))
    return found.withColumn("_last", in_force).select("_fact.*", "_last.*")


def row_hash(df: DataFrame, skip: Sequence[str] = ()) -> Column:
    """Digest of all columns but the skipped; NULL and empty text differ."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in skip]), {"ignoreNullFields": "false"}), 256)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, _cdc_op``: INSERT, UPDATE or DELETE for each key that differs between two snapshots."""
    common = [c for c in before.columns if c in after.columns]
    old = before.select(key, row_hash(before.select(*common), [key]).alias("_old"))
    new = after.select(key, row_hash(after.select(*common), [key]).alias("_new"))
    op = F.when(F.col("_old").isNull(), "INSERT").when(F.col("_new").isNull(), "DELETE").when(F.col("_old") != F.col("_new"), "UPDATE")
    return old.join(new, key, "full_outer").select(key, op.alias("_cdc_op")).where("_cdc_op is not null")


#: Rows that one task numbers, about.
PART_ROWS = 100_000


def tag_changes(df: DataFrame, op: str | Column, source: str, now: str, first_sequence: int | None = None) -> DataFrame:
    """CDC columns; with ``first_sequence`` also a gapless ``_cdc_seq`` in partition order."""
    out = df.withColumns({"_cdc_op": F.lit(op) if isinstance(op, str) else op, "_cdc_ts": F.lit(now).cast("timestamp"), "_cdc_source": F.lit(source)})
    if first_sequence is None:
        return out
    # Rows are counted within hash parts, and the parts' counts summed up, so that no task numbers all rows.
    parts = max(1, df.count() // PART_ROWS)
    out = out.withColumn("_h", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).withColumn("_part", F.pmod("_h", F.lit(parts)))
    sums = out.groupBy("_part").agg(F.count("*").alias("_n"))
    sums = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    n = F.row_number().over(Window.partitionBy("_part").orderBy("_h"))
    return out.join(F.broadcast(sums), "_part").withColumn("_cdc_seq", F.col("_before") + n - 1 + first_sequence).drop("_h", "_part", "_before")


def tag_against(existing: DataFrame, incoming: DataFrame, key: str, source: str, now: str) -> DataFrame:
    """Incoming rows tagged INSERT if their key is new, else UPDATE if they differ; equal rows are left out."""
    common = [c for c in incoming.columns if c in existing.columns]
    old = existing.select(F.col(key).alias("_key"), row_hash(existing.select(*common), [key]).alias("_old"))
    both = incoming.withColumn("_new", row_hash(incoming.select(*common), [key])).join(old, F.col(key) == F.col("_key"), "left")
    both = both.where(F.col("_old").isNull() | (F.col("_old") != F.col("_new")))
    return tag_changes(both, F.when(F.col("_old").isNull(), "INSERT").otherwise("UPDATE"), source, now).drop("_key", "_old", "_new")

"""Proportional stratified interleaving of documents into shards.

Rows are shuffled by a seeded digest within each source, get the fractional rank
(2 r + 1) / (2 n) there, and are sorted by it over all sources; equal cuts of that
order then hold every source in its share of the whole. Shard sizes in rows differ
by one at most (law ``rows``).

Both rankings are made in two levels, so that no source and no range of ranks has to
pass one task: rows fall into buckets by digest prefix (or by fractional rank), the
bucket counts are summed up, and only the rows of one bucket are sorted together.

Nulls: a null text counts as empty, a null source is a source of its own, a null id
is shuffled as the empty string. The digest covers id and text, so that rows without an id spread.
Repeated rows tie and each take a slot of their own, in any order; they are alike. Very long texts are
only measured. Columns beyond the three named are not read, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm.common import cut, join_smaller, text_or_empty

#: Times its share of rows from which a bucket is dealt further.
CROWDED = 8


def interleave_shards(
    docs: DataFrame,
    n_shards: int = 40,
    seed: str = "interleave-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_bucket: int = 2_500,
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, source``."""
    text = text_or_empty(text_col)
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("place"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.crc32(text.cast("binary")).cast("string")).cast("binary")).alias("key"),
        ).withColumn("stratum", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    )
    total = base.count()
    # Buckets and rows in a bucket both grow with the root of the table, so that neither's order is long.
    rows_per_bucket = max(rows_per_bucket, isqrt(total))
    buckets = max(1, -(-total // rows_per_bucket))
    digits = max(1, (max(buckets - 1, 1).bit_length() + 3) // 4)
    tie = ["key", "doc_id", "text_crc32"]

    base = base.withColumn("digits", F.substring("key", 1, digits))
    # A bucket far over its share holds a row repeated very often: its rows are dealt by key and then by place.
    crowded = cut(base.groupBy("stratum", "digits").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED * rows_per_bucket).select("stratum", "digits", F.lit(True).alias("crowded")))
    base = join_smaller(base, crowded, ["stratum", "digits"], "left")
    fine = F.struct(F.when(F.col("crowded"), F.col("key")).alias("key"), F.when(F.col("crowded"), F.pmod(F.xxhash64("place"), F.lit(buckets))).alias("deal"))
    base = base.withColumn("fine", fine)
    counts = base.groupBy("stratum", "digits", "fine").agg(F.count("*").alias("n"))
    in_source = Window.partitionBy("stratum")
    before = counts.select(
        "stratum",
        "digits",
        "fine",
        (F.sum("n").over(in_source.orderBy("digits", "fine")) - F.col("n")).alias("before"),
        F.sum("n").over(in_source).alias("of_source"),
    )
    ranked = base.join(before, ["stratum", "digits", "fine"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("stratum", "digits", "fine").orderBy(*tie)) - 1
    )
    ranked = cut(
        ranked.withColumn("share", (2 * F.col("rank") + 1) / (2 * F.col("of_source")))
        .withColumn("cell", F.floor(F.col("share") * buckets))
        .select("doc_id", "source", "stratum", "size", "text_crc32", "key", "share", "cell")
    )
    cells = ranked.groupBy("cell").agg(F.count("*").alias("n"))
    starts = cells.select("cell", (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("cell").orderBy("share", "stratum", *tie)) - 1
    placed = ranked.join(starts, "cell").withColumn("place", place)
    shard = F.expr(f"(place * {n_shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return placed.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )

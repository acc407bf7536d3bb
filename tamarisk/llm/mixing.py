"""Mixing sources to target weights by Pareto order sampling, counted in words.

Sources take their weights in turn, by code point and null last, and share the words of all
documents; a source gets ``max_copies`` times its size at most, and what it can't take is shared by
weight among the others. Within a source a document is expected min(max_copies, f w) times, where w
is its weight (by default the number of binary digits of its size, so that longer documents are
likelier, and none much likelier) and f is set so that the expected words are the target. The whole
copies of that are certain; its fraction p is the inclusion probability of one copy more. Documents
are ranked by their random odds u / (1 - u) divided by the inclusion odds p / (1 - p), and the first
of them are taken. The sample has a fixed size in words: it ends at the document whose middle passes
the words that the certain copies leave of the target, so that a source misses its target by half
a document at most.

The end of a sample is searched by ranges of ranks, a prefix of the order each time: only sums by
range are ordered together, so that no source, and no group of alike rows, has to pass one task.

Nulls: a null text has no words and is never taken, as an empty one; a null source is a source of
its own; a null id is drawn as the empty string, together with a digest of the text. Repeated rows
tie and are alike, so that reruns agree whichever of them is taken. Very long texts are only counted
and digested. Columns that aren't named are not read, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm.common import WORD, cut, join_smaller, text_or_empty

#: Ranges that one step of the search tells apart.
RANGES = 1 << 16


def _share(cap: Column, unit: Column, amount: Column, by: Column, over: list) -> Column:
    """f such that the sum of least(cap, f * unit) is ``amount`` in each group ``over`` (null: every cap is reached).

    ``by`` orders rows from those that reach their cap first.
    """
    ordered = Window.partitionBy(*over).orderBy(by)
    before = F.coalesce(F.sum(cap).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(unit).over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    factor = F.when(rest > 0, (amount - before) / rest)
    first = F.min(F.when(cap > factor * unit, F.struct(by.alias("by"), factor.alias("factor")))).over(Window.partitionBy(*over))
    return first["factor"]


def targets(sizes: DataFrame, weights: Sequence[int], max_copies: int) -> DataFrame:
    """``source, source_size, target`` of a table with a row for each source."""
    everything = Window.partitionBy()
    numbered = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    capped = numbered.withColumns({"cap": max_copies * F.col("source_size"), "total": F.sum("source_size").over(everything)})
    by = F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("name"))
    shared = capped.withColumn("factor", _share(F.col("cap"), F.col("weight"), F.col("total"), by, []))
    return shared.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("factor") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def copies(classes: DataFrame, max_copies: int) -> DataFrame:
    """``stratum, class, whole, chance, extra``: certain copies, probability of one more, and the words that are left to draw in the source.

    ``classes`` has ``stratum, class, words, target``: documents of one weight in one source.
    """
    cap = F.when(F.col("class") > 0, max_copies * F.col("words")).otherwise(F.lit(0))
    factor = _share(cap, F.col("class") * F.col("words"), F.col("target"), -F.col("class"), ["stratum"])
    most = F.when(F.col("class") > 0, F.lit(float(max_copies))).otherwise(F.lit(0.0))
    found = classes.withColumn("factor", factor).withColumn("expected", F.coalesce(F.least(most, F.col("factor") * F.col("class")), most))
    found = found.withColumns({"whole": F.floor("expected"), "chance": F.col("expected") - F.floor("expected")})
    return found.withColumn("extra", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("stratum")))


def _ends(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``stratum, last_in, first_out``: where the order of each stratum passes ``extra`` words; strata that never do are left out.

    ``rows`` (checkpointed) has ``stratum, size, place, key, row``. The search goes through ever
    narrower ranges of the order (place, key, spread, row): first of places, then rows alike in
    place and key, spread over ranges by their number, and at last single rows.
    """
    prefixes = [
        [F.floor(F.col("place") * RANGES).alias("a")],
        [F.floor(F.col("place") * RANGES * RANGES).alias("a")],
        [F.col("place").alias("a"), F.col("key").alias("b")],
        [F.col("place").alias("a"), F.col("key").alias("b"), F.col("spread").alias("c")],
    ]
    here, at = limits.select("stratum", F.col("extra").alias("left")), None
    for prefix in prefixes:
        found = join_smaller(rows, here, "stratum", "inner")
        if at is not None:
            found = found.where(F.struct(*at) == F.col("at"))
        sums = found.groupBy("stratum", "left", F.struct(*prefix).alias("at")).agg(F.sum("size").alias("n"))
        end = F.sum("n").over(Window.partitionBy("stratum").orderBy("at"))
        passed = sums.withColumn("end", end).where(F.col("end") > F.col("left"))
        first = passed.groupBy("stratum").agg(F.min(F.struct("at", (F.col("left") - (F.col("end") - F.col("n"))).alias("left"))).alias("f"))
        here, at = cut(first.select("stratum", "f.at", "f.left")), prefix
    found = join_smaller(rows, here, "stratum", "inner").where(F.struct(*at) == F.col("at"))
    before = F.sum("size").over(Window.partitionBy("stratum").orderBy("row")) - F.col("size")
    judged = found.withColumn("fits", 2 * before + F.col("size") <= 2 * F.col("left"))
    return judged.groupBy("stratum").agg(F.max(F.when(F.col("fits"), _order())).alias("last_in"), F.min(F.when(~F.col("fits"), _order())).alias("first_out"))


def _order() -> Column:
    return F.struct("place", "key", "spread", "row")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    max_copies: int = 3,
    seed: str = "pareto-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken`` and the columns to ``carry``.

    ``weight``: a whole number (0: never) by which documents of one source are preferred, of some
    dozens of values; it may use ``size``, the number of words.
    """
    text = text_or_empty(text_col)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    read = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(name.cast("binary")).alias("key"),
        F.monotonically_increasing_id().alias("row"),
        *[F.col(c).alias(f"carry_{c}") for c in carry],
    )
    preferred = weight.cast("long") if weight is not None else F.length(F.bin("size")).cast("long")
    base = cut(
        read.withColumns({
            "class": F.when(F.col("size") > 0, F.coalesce(preferred, F.lit(0))).otherwise(F.lit(0)),
            "stratum": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")),
            "spread": F.pmod(F.xxhash64("row"), F.lit(RANGES)),
        })
    )
    classes = cut(base.groupBy("stratum", "source", "class").agg(F.sum("size").alias("words")))
    sources = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_copies)
    sources = sources.withColumn("stratum", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).drop("source")
    plan = cut(copies(classes.drop("source").join(sources, "stratum"), max_copies))

    u = (F.conv(F.substring("key", 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    odds = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
    drawn = join_smaller(base.where("class > 0"), plan.where("chance > 0").select("stratum", "class", "chance"), ["stratum", "class"], "inner")
    rows = cut(drawn.withColumn("odds", odds).select("stratum", "size", (F.col("odds") / (1 + F.col("odds"))).alias("place"), "key", "spread", "row"))
    ends = cut(_ends(rows, plan.select("stratum", "extra").distinct()))

    plan = cut(plan.select("stratum", "class", "source_size", "target", "whole", "chance").join(ends, "stratum", "left"))
    both = join_smaller(base, plan, ["stratum", "class"], "inner").withColumn("odds", F.when(F.col("chance") > 0, odds))
    both = both.withColumn("place", F.col("odds") / (1 + F.col("odds")))
    ended = F.col("last_in").isNotNull() | F.col("first_out").isNotNull()
    inside = ~ended | F.coalesce(_order() < F.col("first_out"), _order() <= F.col("last_in"))
    both = both.withColumn("copies", (F.col("whole") + F.when((F.col("chance") > 0) & inside, 1).otherwise(0)).cast("long"))
    return both.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"carry_{c}").alias(c) for c in carry]
    )

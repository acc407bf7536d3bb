"""Corpus preparation in five stages, each a function of (spark, docs, sf_dir).

``docs`` has the columns of ``documents`` (doc_id, text, lang, source, n_chars); every stage
but the last returns them for the documents that it keeps. SimHash near-dedup and
decontamination judge rows by a key of id and text, so that a row with a null id, or with an
id that others have too, stays or goes by itself. Otherwise nulls, repeated rows and empty
tables are handled as in the operators that the stages call. Columns beyond these five are
dropped.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm import decontamination, language, packing, simhash, substrings
from tamarisk.llm.common import cut, join_smaller, table, text_or_empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose prediction scores less is rejected: no language holds it.
MIN_LANGUAGE_SCORE = 0.3


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with ``row_key``: a number, never null, in the order of the ids (null last), then of a digest of 60 bits of the text."""
    place = F.coalesce(F.col("doc_id").cast("decimal(20,0)") + F.lit(Decimal(1 << 63)), F.lit(Decimal(1 << 64)))
    digest = F.shiftrightunsigned(F.xxhash64(text_or_empty()), 4).cast("decimal(19,0)")
    return docs.withColumn("row_key", (place.cast("decimal(20,0)") * F.lit(Decimal(1 << 60)) + digest).cast("decimal(38,0)"))


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose key is not in ``keys`` (a checkpointed column of keys)."""
    return join_smaller(keyed, keys, "row_key", "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without any letter or of no clear language go."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.fit(docs.where(~held_out | F.col("doc_id").isNull()))
    kept = language.identify(docs, model, carry=tuple(COLUMNS[1:]))
    return kept.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, of these that with the smallest digest."""
    keyed = _keyed(docs)
    found = simhash.near_duplicates(keyed, id_col="row_key").withColumnRenamed("doc_id", "row_key")
    gone = cut(found.where(F.col("row_key") != F.col("component_id")).select("row_key").distinct())
    kept = _without(keyed, gone)
    # Rows that share the key as well are one document; only where there are such keys do texts move.
    again = cut(found.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key"))
    if again.limit(1).count():
        once = join_smaller(kept, again, "row_key", "left_semi").dropDuplicates(["row_key"])
        kept = _without(kept, again).select(*COLUMNS).union(once.select(*COLUMNS))
    return kept.select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that repeat; those left without a word go."""
    found = substrings.remove_repeats(docs, carry=tuple(COLUMNS[1:]))
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    shorter = F.col("n_removed") > 0
    return left.select(
        "doc_id",
        F.when(shorter, F.col("kept_text")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(shorter, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = _keyed(docs)
    found = decontamination.find_items(keyed, table(spark, sf_dir, "benchmark"), one_value=False, wordless=True, id_col="row_key")
    return _without(keyed, cut(found.select(F.col("doc_id").alias("row_key")).distinct())).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document with its place."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]
#: The stages hash, label and tokenise in ways that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

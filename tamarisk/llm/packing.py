"""Best-fit packing of documents into token sequences, planned on the length histogram.

1. Every document is tokenised whole and gets an end id; only documents longer than the
   capacity are cut, into pieces of exactly the capacity and a last shorter one.
2. The histogram of piece lengths (as many rows as the capacity at most) goes to the
   driver, and best-fit decreasing runs over its *counts*: equal bins are one entry with a
   multiplicity, so planning costs the same for a thousand or a trillion documents.
3. Pieces are ranked within their length (in two levels, so that a length that a third of
   all documents share is spread over many tasks) and take the planned slot of that rank.

The plan has a few entries per length, bounded by the capacity; it is broadcast.

Nulls: a null text is empty, so its document is the end id alone. Repeated rows are packed
as often as they occur; pieces of one length that tie in id, piece and
digest are alike and take their slots in any order. Very long texts are tokenised whole. Other
columns of the input are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm.common import cut, map_batches

CAPACITY = 2048
#: Entries that a worker's cache of tokenised words holds before it is emptied.
CACHED_WORDS = 200_000
_loaded: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A word of Latin letters (in no need of Unicode normalisation), and such a word with trailing ASCII signs.
_LATIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_WITH_SIGNS = re.compile(_LATIN.pattern[:-1].replace("[a-z", "([0-9a-z") + "+)([!-&(-/:-@\\[-`{-~]+)")


class WordIds(dict):
    """Ids of white-space separated chunks as little-endian bytes, filled on demand.

    The vocabulary's pre-tokeniser drops white space, splits a word from signs after it and
    never joins what it separates, so a text's ids are those of its chunks in order, and a
    chunk's those of its word and signs. Upper-case ASCII letters are lower-cased first (the
    vocabulary's own normaliser does it too), which makes more chunks equal. Plain Latin words
    go straight to the merges, whatever else through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        latin = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
        self.as_bytes = {ord(c): byte_level.pre_tokenize_str(c.lower())[0][0] for c in latin}

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        if _LATIN.fullmatch(text):
            ids = array("I", [t.id for t in self.merge(text.translate(self.as_bytes))]).tobytes()
        elif parts := _WITH_SIGNS.fullmatch(text):
            ids = self[parts[1].encode("utf-8")] + self[parts[2].encode("utf-8")]
        else:
            ids = array("I", self.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        data = text.encode("utf-8")
        if b"<|" not in data:
            data = data.lower()
        return b"".join(map(self.__getitem__, data.split()))


def pieces(
    docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of all documents."""
    path = vocabulary or default_vocabulary()
    id_type = dict(docs.dtypes)[id_col]
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    end = int(end_id).to_bytes(4, "little")

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        if path not in _loaded:
            _loaded[path] = WordIds(path)
        ids_of = _loaded[path].of
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("at", "piece", "start", "length", "ids_crc32")}
            kept = []
            for at, text in enumerate(batch["text"]):
                data = ids_of(text or "") + end
                for n, start in enumerate(range(0, len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + capacity)]
                    rows["at"].append(at)
                    rows["piece"].append(n)
                    rows["start"].append(start)
                    rows["length"].append(len(part) // 4)
                    rows["ids_crc32"].append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            at = rows.pop("at")
            out = pd.DataFrame({"doc_id": batch["doc_id"].take(at).reset_index(drop=True), **rows})
            if keep_ids:
                out["ids"] = kept
            yield out
        _loaded[path].clear()  # the words of this task; the tokenizer stays

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), cut_up, schema)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns entries ``(length, first_rank, last_rank, per_bin, first_bin, offset)``: the pieces of
    that length whose rank lies in [first_rank, last_rank] go ``per_bin`` to a bin, from
    ``first_bin`` on, from ``offset`` on. Placing an item into the tightest bin leaves that bin
    the tightest while it still fits, so a bin takes as many equal items as it can at once.
    """
    bins: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first bin, number of bins)
    rooms: list[int] = []
    entries = []
    n_bins = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in bins:
                insort(rooms, room)
            bins.setdefault(room, []).append((first, n))

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:
                room, first, n = capacity, n_bins, -(-left // (capacity // length))
                n_bins += n
            fit = room // length
            full = min(n, left // fit)
            if full:
                entries.append((length, rank, rank + full * fit - 1, fit, first, capacity - room))
                put(room - fit * length, first, full)
                rank, left = rank + full * fit, left - full * fit
            if full < n and 0 < left < fit:
                entries.append((length, rank, rank + left - 1, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                put(room, first + full + 1, n - full - 1)
                rank, left = rank + left, 0
            elif full < n:
                put(room, first + full, n - full)
    return entries


def pack(
    docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 250,
) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``)."""
    spark = docs.sparkSession
    cut_pieces = cut(pieces(docs, vocabulary, capacity, end_id, keep_ids, id_col, text_col))
    # Alike pieces (null ids, repeated rows) are told apart by their place in the checkpoint, which stays as it is.
    salted = cut_pieces.withColumn("salt", F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_slots(histogram, capacity)
    slots = F.broadcast(
        spark.createDataFrame(
            plan or [(0, 0, -1, 1, 0, 0)], "slot_length long, first_rank long, last_rank long, per_bin long, first_bin long, at long"
        )
    )
    # A length with many pieces is ranked in as many parts as it fills buckets.
    parts = [(length, -(-n // max(rows_per_bucket, isqrt(n)))) for length, n in sorted(histogram.items())] or [(0, 1)]
    parts_df = F.broadcast(spark.createDataFrame(parts, "length long, parts long"))
    salted = salted.join(parts_df, "length").withColumn("part", F.pmod("salt", "parts"))
    before = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = before.select(
        "length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    )
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    taken = ranked.join(
        slots, (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank"))
    )
    nth = F.col("rank") - F.col("first_rank")
    return taken.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )

"""Exact substring deduplication on the De Bruijn graph of token k-mers.

An edge of the graph is a window of ``k`` words (its ends are the windows' first and last
k - 1 words). Only edges that start at two or more places matter:

1. *Sieve.* Every edge has a minimiser, the smallest hash of the shorter word windows in it.
   Equal edges have equal minimisers, so edges whose minimiser occurs at one place only are
   left out. The repeated minimisers are kept in a bit table of eight bits for each, ``sieve_bits`` (a power
   of two) at most, which is broadcast; a full table lets more edges through but loses none.
2. *Hot edges.* Edges that stand at more than ``hot_places`` places (and at more than a millionth
   of all places, so that there are 2 ** 20 at most) are counted by Spark's own aggregation, combined in every task before the shuffle;
   their list is broadcast, and they are left out of the next step. So no group there grows with a common passage.
3. *Count.* The edges left go, as packed arrays of hashes, to buckets of the hash. A bucket
   finds the edges that occur twice or more and whether all occurrences have the same word
   before and after; if not, the graph branches there. Equal edges of a block of documents
   are one entry, so a passage that a third of all documents hold is combined before the shuffle.
4. *Compact.* Consecutive repeated edges without a branch between them make fragments, which end at a
   branch or where the next edge's hash says so (about every ``FRAGMENT`` edges), alike wherever they
   occur. Different fragments are nodes, each with the one before it; joins that double the step find the head of each
   nonbranching path and the distance to it. Back in the source coordinates, fragments of one path at one place are one span, and a
   join with the number of places of its path and length confirms it by a second one. Two fragments that share a digest
   by chance but not what stands before them are not compacted, so that none gets the other's head.
5. *Remove.* Every word that a confirmed span covers is taken out.

Hashes: 64 bits compare edges within a bucket, and the bucket comes from a second, independent
hash. Block numbers come from the input partitions; the input should be read from files (or
otherwise have a fixed row order), as recomputed partitions must hold the same rows.

Nulls: a null text is empty, a null id is an id like any other. Repeated rows repeat each
other's windows and lose them all; rows that tie in id and text get the same result. Texts shorter than ``k`` words stay whole; very long ones are a block
of their own. Columns beyond id, text and those carried are not read, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import WORD_RE, cut, give_back, map_batches, text_or_empty

_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE, _BASE_2 = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)
_TAILS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_LONG = 64
#: A fragment ends before an edge whose hash is a multiple of this.
FRAGMENT = 128
#: Windows that a block of documents holds at most.
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the number of words of each text."""
    import xxhash

    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join(coded) + b" " * 9
    raw = np.frombuffer(data, np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.nonzero(~gap & np.concatenate([[True], gap[:-1]]))[0]
    ends = np.nonzero(gap & np.concatenate([[False], ~gap[:-1]]))[0]
    sizes = ends - starts
    eight = np.ndarray((len(raw) - 7,), np.dtype("<u8"), data, 0, (1,))
    hashes = mix(sizes.astype(np.uint64) * _C3)
    active = np.nonzero(sizes <= _LONG)[0]
    lane = 0
    while len(active):
        left = sizes[active] - lane
        part = eight[starts[active] + lane] & _TAILS[np.minimum(left, 8)]
        hashes[active] = mix((hashes[active] ^ part) * _C3 + np.uint64(lane + 1))
        lane += 8
        active = active[left > 8]
    for at in np.nonzero(sizes > _LONG)[0]:
        hashes[at] = xxhash.xxh64_intdigest(data[starts[at] : ends[at]])
    edges = np.cumsum([len(c) + 1 for c in coded])
    return hashes, np.diff(np.searchsorted(starts, np.concatenate([[0], edges]))).astype(np.int64)


def rolling(values: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every ``k`` consecutive values, by doubling."""
    n = max(0, len(values) - k + 1)
    total, done = np.zeros(n, np.uint64), 0
    power, width, power_of = values, 1, base
    while True:
        if k & width:
            total = total * power_of + power[done : done + n]
            done += width
        if done == k:
            return total
        power = power[:-width] * power_of + power[width:]
        width, power_of = 2 * width, np.uint64(int(power_of) ** 2 & 0xFFFFFFFFFFFFFFFF)


def smallest(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by doubling."""
    out, width = values, 1
    while 2 * width <= w:
        out, width = np.minimum(out[:-width], out[width:]), 2 * width
    n = len(values) - w + 1
    return np.minimum(out[:n], out[w - width : w - width + n]) if n > 0 else values[:0]


class Windows:
    """All edges of the texts of a block, one after the other."""

    def __init__(self, texts: list[str], k: int) -> None:
        self.k, self.inner = k, (k + 1) // 2
        self.words, self.lengths = word_hashes(texts)
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths
        n = max(0, len(self.words) - k + 1)
        own_end = np.repeat(ends, self.lengths)[:n]
        self.valid = np.arange(n) + k <= own_end
        self.anchors = mix(rolling(self.words, self.inner, _BASE))
        self.least = smallest(self.anchors, k - self.inner + 1)[:n]

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        """Minimisers of valid edges with the number of places they stand at."""
        chosen = np.zeros(len(self.anchors), bool)
        n = len(self.least)
        for i in range(self.k - self.inner + 1):
            chosen[i : i + n] |= self.valid & (self.anchors[i : i + n] == self.least)
        return np.unique(self.anchors[chosen], return_counts=True)


def blocks_of(batch: pd.DataFrame, most_words: int) -> Iterator[pd.DataFrame]:
    """Rows of a batch in groups of about ``most_words`` words; one longer text is a group of its own."""
    low, held = 0, 0
    for at, size in enumerate(batch["text"].str.len()):
        if held and held + size // 6 > most_words:
            yield batch.iloc[low:at]
            low, held = at, 0
        held += size // 6
    if low < len(batch):
        yield batch.iloc[low:]


def bits_for(held: int, most_bits: int) -> int:
    """Eight bits of a table for each hash, to the next power of two, at most 2 ** most_bits."""
    return min(most_bits, max(3, (8 * held).bit_length()))


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """Table of 2 ** bits bits, set at the low bits of the hashes in column ``a``; packed by Spark in 1,024 segments."""
    segment = max(3, bits - 10)
    places = hashes.select(F.col("a").bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    places = places.select(F.shiftright("at", segment).alias("segment"), F.col("at").bitwiseAND(F.lit((1 << segment) - 1)).alias("at"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << segment, np.uint8)
        held[rows["at"]] = 1
        return pd.DataFrame({"segment": [key[0]], "held": [np.packbits(held, bitorder="little").tobytes()]})

    table = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << segment) // 8
    packed = cut(places.groupBy("segment").applyInPandas(pack, "segment long, held binary"))
    for row in packed.coalesce(16).toLocalIterator():  # a job for each part
        table[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["held"], np.uint8)
    return table


def held_in(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of the hashes are set."""
    at = hashes & np.uint64(8 * len(table) - 1)
    return ((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def sieve(docs: DataFrame, k: int, most_bits: int, hot_places: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bit table of the minimisers that stand at two or more places, the hot ones among them, and the places that make an edge hot."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in blocks_of(batch, BLOCK):
                found, n = Windows(block["text"].tolist(), k).minimisers()
                yield pd.DataFrame({"a": found.view(np.int64), "n": n})

    counts = cut(map_batches(docs.select("text"), gather, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1"))
    held, total = counts.agg(F.count("*"), F.sum("n")).first()
    bits = bits_for(held, most_bits)
    limit = max(hot_places, (total or 0) * (k - (k + 1) // 2 + 1) >> 20)  # no place serves more windows than that
    hot = np.sort(np.array([x["a"] for x in counts.where(F.col("n") > limit).select("a").collect()], dtype=np.int64).view(np.uint64))  # 2 ** 20 at most
    return bit_table(counts, bits), hot, limit


class Edges:
    """Edges of a block at the places given, with the words before and after as 32-bit hashes: 0 at a text's border, always a branch."""

    def __init__(self, win: Windows, places: np.ndarray) -> None:
        k = win.k
        self.places = places.astype("<u4")
        self.hashes = rolling(win.words, k, _BASE)[places]
        self.second = mix(rolling(win.words, k, _BASE_2)[places])
        short = np.concatenate([[0], (win.words >> np.uint64(32)) | np.uint64(1), [0]]).astype("<u4")
        starts = np.isin(places, win.starts)
        ends = np.isin(places + k, np.append(win.starts[1:], len(win.words)))
        self.before = np.where(starts, 0, short[places]).astype("<u4")
        self.after = np.where(ends, 0, short[places + k + 1]).astype("<u4")

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """First place, number of the edge at each place, counts, and the least and greatest neighbours of different edges."""
        _, first, inverse, n = np.unique(self.hashes, return_index=True, return_inverse=True, return_counts=True)
        least = [np.full(len(first), 0xFFFFFFFF, "<u4"), np.full(len(first), 0xFFFFFFFF, "<u4")]
        most = [np.zeros(len(first), "<u4"), np.zeros(len(first), "<u4")]
        for i, x in enumerate((self.before, self.after)):
            np.minimum.at(least[i], inverse, x)
            np.maximum.at(most[i], inverse, x)
        return first, inverse, n, least, most


class HotEdges(NamedTuple):
    hashes: np.ndarray  # sorted
    second: np.ndarray
    flags: np.ndarray

    def at(self, edges: Edges) -> tuple[np.ndarray, np.ndarray]:
        """Whether each edge is hot, and its number here."""
        if not len(self.hashes):
            return np.zeros(len(edges.hashes), bool), np.zeros(len(edges.hashes), np.int64)
        number = np.minimum(np.searchsorted(self.hashes, edges.hashes), len(self.hashes) - 1)
        return (self.hashes[number] == edges.hashes) & (self.second[number] == edges.second), number


def hot_edges(docs: DataFrame, k: int, minimisers: np.ndarray, limit: int) -> HotEdges:
    """Edges that stand at more than ``limit`` places, with their branches; counted by hash, combined in the tasks."""
    if not len(minimisers):
        return HotEdges(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    shared = docs.sparkSession.sparkContext.broadcast(minimisers)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot = shared.value
        for batch in batches:
            for block in blocks_of(batch, BLOCK):
                win = Windows(block["text"].tolist(), k)
                near = np.minimum(np.searchsorted(hot, win.least), len(hot) - 1)
                edges = Edges(win, np.nonzero(win.valid & (hot[near] == win.least))[0])
                first, _, n, least, most = edges.distinct()
                columns = {"h": edges.hashes[first].view(np.int64), "s": edges.second[first].view(np.int64), "n": n}
                columns |= {c: x.astype(np.int64) for c, x in zip(("b0", "a0", "b1", "a1"), (*least, *most), strict=True)}
                yield pd.DataFrame(columns)

    rows = map_batches(docs.select("text"), gather, "h long, s long, n long, b0 long, a0 long, b1 long, a1 long")
    found = rows.groupBy("h", "s").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in ("b0", "a0")), *(F.max(c).alias(c) for c in ("b1", "a1")))
    branch = lambda low, high, bit: F.when((F.col(low) != F.col(high)) | (F.col(low) == 0), bit).otherwise(0)
    kept = found.where(F.col("n") > limit).select("h", "s", (branch("b0", "b1", 1) + branch("a0", "a1", 2)).alias("flags")).collect()  # 2 ** 20 at most
    h, second, flags = (np.array([x[c] for x in kept], dtype=np.int64) for c in ("h", "s", "flags"))
    order = np.argsort(h.view(np.uint64))
    return HotEdges(h.view(np.uint64)[order], second.view(np.uint64)[order], flags[order].astype(np.uint8))


def steps(places: np.ndarray) -> bytes:
    """Ascending places as differences."""
    return np.diff(places, prepend=places.dtype.type(0)).astype("<u4").tobytes()


def places_of(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u4"), dtype=np.uint32)


def names_of(hashes: np.ndarray) -> np.ndarray:
    """What the digests of paths know an edge by: its whole hash."""
    return hashes.astype("<u8")


_PACKED = "bucket long, block string, kind string, hashes binary, places binary, before binary, after binary, many binary, ids array<string>, digests array<long>"
_FOUND = "block string, kind string, places binary, flags binary, hashes binary, before binary, ids array<string>, digests array<long>"


def repeated_fragments(docs: DataFrame, k: int = 35, sieve_bits: int = 30, per_bucket: int = 1_000_000, hot_places: int = 1_000) -> DataFrame:
    """``id, digest, start, n_edges, path, before, n_before``: nonbranching fragments of repeated edges, by document.

    ``path`` is the digest of a fragment, ``before`` that of the fragment which always stands before it (0: none).

    ``docs`` has the columns id, digest and text.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(8, size // 6 // per_bucket)
    bits, minimisers, limit = sieve(docs, k, sieve_bits, hot_places)
    table = spark.sparkContext.broadcast(bits)  # 2 ** sieve_bits / 8 bytes at most
    hot = spark.sparkContext.broadcast(hot_edges(docs, k, minimisers, limit))

    def request(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, count = TaskContext.get().partitionId(), 0
        held = table.value
        for batch in batches:
            for rows in blocks_of(batch, BLOCK):
                win = Windows(rows["text"].tolist(), k)
                passed = win.valid & held_in(held, win.least)
                places = np.nonzero(passed)[0]
                if not len(places):
                    continue
                name = f"{task}-{count}"
                count += 1
                edges = Edges(win, places)
                known, number = hot.value.at(edges)
                own = {"block": name, "before": b"", "after": b"", "many": b"", "ids": None, "digests": None}
                out = []
                if known.any():
                    numbers = number[known].astype("<u4").tobytes()
                    out.append({**own, "bucket": hash_of_block(task, count) % n_buckets, "kind": "hot", "hashes": numbers, "places": steps(edges.places[known])})
                    edges = Edges(win, places[~known])
                first, inverse, n, least, most = edges.distinct()
                places, hashes = edges.places, edges.hashes
                sides = [np.where(x == y, x, 0).astype("<u4") for x, y in zip(least, most, strict=True)]
                copies = np.ones(len(places), bool)
                copies[first] = False
                pairs = np.stack([places[copies], places[first[inverse[copies]]]]).astype("<u4")
                starts = {"hashes": win.starts.astype("<i8").tobytes(), "places": pairs.tobytes(), "ids": rows["id"].tolist(), "digests": rows["digest"].tolist()}
                out.append({**own, "bucket": hash_of_block(task, count) % n_buckets, "kind": "block", **starts})
                by_place = np.argsort(first)  # places that follow each other take little room
                first, n, sides = first[by_place], n[by_place], [x[by_place] for x in sides]
                bucket = (edges.second[first] % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                for b in np.nonzero(np.diff(bounds))[0]:
                    take = order[bounds[b] : bounds[b + 1]]
                    out.append({
                        "bucket": int(b), "block": name, "kind": "edges", "hashes": hashes[first[take]].tobytes(), "places": steps(places[first[take]]),
                        "before": sides[0][take].tobytes(), "after": sides[1][take].tobytes(), "many": (n[take] > 1).astype(np.uint8).tobytes(),
                        "ids": None, "digests": None,
                    })
                yield pd.DataFrame(out)

    def count_edges(rows: pd.DataFrame) -> pd.DataFrame:
        out = [
            {"block": r.block, "kind": "block", "places": r.places, "flags": b"", "hashes": b"", "before": r.hashes, "ids": r.ids, "digests": r.digests}
            for r in rows[rows["kind"] == "block"].itertuples()
        ]
        out += [
            {"block": r.block, "kind": "hot", "places": r.places, "flags": b"", "hashes": r.hashes, "before": b"", "ids": None, "digests": None}
            for r in rows[rows["kind"] == "hot"].itertuples()
        ]
        edges = rows[rows["kind"] == "edges"]
        if len(edges):
            joined = {c: np.concatenate([np.frombuffer(x, t) for x in edges[c]]) for c, t in (("hashes", "<u8"), ("before", "<u4"), ("after", "<u4"), ("many", "u1"))}
            order = np.argsort(joined["hashes"], kind="stable")
            sorted_hashes = joined["hashes"][order]
            heads = np.nonzero(np.concatenate([[True], sorted_hashes[1:] != sorted_hashes[:-1]]))[0]
            total = np.add.reduceat(joined["many"][order].astype(np.int64) + 1, heads)
            flags = np.zeros(len(heads), np.uint8)
            for bit, c in ((1, "before"), (2, "after")):
                x = joined[c][order]
                lo, hi = np.minimum.reduceat(x, heads), np.maximum.reduceat(x, heads)
                flags |= np.where((lo != hi) | (lo == 0), bit, 0).astype(np.uint8)
            group = np.zeros(len(order), np.int64)
            group[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
            twice, of_all = (total > 1)[group], flags[group]
            low_at = 0
            for r in edges.itertuples():
                places = places_of(r.places)
                part = slice(low_at, low_at + len(places))
                low_at += len(places)
                kept = twice[part]
                if kept.any():
                    out.append({
                        "block": r.block, "kind": "edges", "places": steps(places[kept]), "flags": of_all[part][kept].tobytes(),
                        "hashes": names_of(joined["hashes"][part][kept]).tobytes(), "before": b"", "ids": None, "digests": None,
                    })
        give_back()
        return pd.DataFrame(out, columns=["block", "kind", "places", "flags", "hashes", "before", "ids", "digests"])

    def fragments(rows: pd.DataFrame) -> pd.DataFrame:
        edges, known = rows[rows["kind"] == "edges"], rows[rows["kind"] == "hot"]
        if not len(edges) + len(known):
            return pd.DataFrame([], columns=["id", "digest", "start", "n_edges", "path", "before", "n_before"])  # a block whose edges all stand at one place
        block = rows[rows["kind"] == "block"].iloc[0]
        numbers = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(x, "<u4") for x in known["hashes"])])
        places = np.concatenate([*map(places_of, edges["places"]), *map(places_of, known["places"])])
        flags = np.concatenate([*(np.frombuffer(x, "u1") for x in edges["flags"]), hot.value.flags[numbers]])
        names = np.concatenate([*(np.frombuffer(x, "<u8") for x in edges["hashes"]), names_of(hot.value.hashes[numbers])])
        order = np.argsort(places)
        places, flags, names = places[order], flags[order], names[order]
        copies = np.frombuffer(block["places"], "<u4").reshape(2, -1)
        like = np.searchsorted(places, copies[1])  # copies in the block are repeated, and so is the edge sent for them
        places = np.concatenate([places, copies[0]]).astype(np.int64)
        flags, names = np.concatenate([flags, flags[like]]), np.concatenate([names, names[like]])
        order = np.argsort(places)
        places, flags, names = places[order], flags[order], names[order]
        starts = np.frombuffer(block["before"], "<i8")
        doc = np.searchsorted(starts, places, side="right") - 1
        new = np.ones(len(places), bool)  # nothing before, or a branch
        new[1:] = (np.diff(places) != 1) | (np.diff(doc) != 0) | ((flags[1:] & 1) > 0) | ((flags[:-1] & 2) > 0)
        first = np.nonzero(new | ((names >> np.uint64(32)) % np.uint64(FRAGMENT) == 0))[0]
        n_edges = np.diff(np.append(first, len(places)))
        own = doc[first]
        # A fragment's digest covers all its edges in order, and their number.
        at = np.arange(len(places)) - np.repeat(first, n_edges)
        path = mix(np.add.reduceat(mix(names + mix(at.astype(np.uint64) * _C3)), first) + n_edges.astype(np.uint64) * _C3)
        return pd.DataFrame({
            "id": np.array(block["ids"], dtype=object)[own], "digest": np.array(block["digests"], dtype=np.int64)[own],
            "start": places[first] - starts[own], "n_edges": n_edges, "path": path.view(np.int64),
            "before": np.where(new[first], 0, np.roll(path.view(np.int64), 1)), "n_before": np.where(new[first], 0, np.roll(n_edges, 1)),
        })

    packed = map_batches(docs, request, _PACKED)
    found = packed.groupBy("bucket").applyInPandas(count_edges, _FOUND)
    return found.groupBy("block").applyInPandas(fragments, "id string, digest long, start long, n_edges long, path long, before long, n_before long")


def hash_of_block(task: int, count: int) -> int:
    return (task * 1_000_003 + count * 7_919) & 0x7FFFFFFF


def heads(nodes: DataFrame) -> DataFrame:
    """``path, head, distance`` of all fragments that have one before them (``path, before, n_before``).

    Every round joins each fragment with the one it points to and points to that one's instead, so rounds grow with the
    logarithm of the longest path. A path has a head, as the first edge of a text is a branch.
    """
    found = cut(nodes.select("path", F.col("before").alias("head"), F.col("n_before").alias("distance")))
    moved = found.count()
    while moved:
        above = found.select(F.col("path").alias("head"), F.col("head").alias("further"), F.col("distance").alias("more"))
        both = found.join(above, "head", "left")
        ahead = F.col("further").isNotNull()
        following = cut(both.select("path", F.coalesce("further", "head").alias("head"), (F.col("distance") + F.coalesce("more", F.lit(0))).alias("distance"), ahead.alias("moved")))
        moved, found = following.where("moved").count(), following.drop("moved")
    return found


def confirmed_spans(fragments: DataFrame) -> DataFrame:
    """``id, digest, start, n_edges, n_places``: the nonbranching paths that stand, with the same extent, at two or more places."""
    # Different fragments that share a digest differ in what stands before them: such a digest begins a path of its own.
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("before", "n_before") for f in (F.min, F.max)]
    nodes = fragments.groupBy("path").agg(*ends).where("min_before = max_before and min_n_before = max_n_before and max_before != 0")
    nodes = nodes.select("path", F.col("max_before").alias("before"), F.col("max_n_before").alias("n_before"))
    placed = fragments.join(heads(nodes), "path", "left").withColumns({"head": F.coalesce("head", "path"), "distance": F.coalesce("distance", F.lit(0))})
    # Rows of equal id and text have the same places: those of the head say how many there are.
    spans = placed.groupBy("id", "digest", "head", (F.col("start") - F.col("distance")).alias("start")).agg(
        (F.max(F.col("start") + F.col("n_edges")) - F.min("start")).alias("n_edges"), F.count_if(F.col("distance") == 0).alias("copies")
    )
    # Written first, so that a path which very many documents hold can be split in the join.
    spans = cut(spans)
    counts = cut(spans.groupBy("head", "n_edges").agg(F.sum("copies").alias("n_places")).where("n_places > 1"))
    return spans.join(counts, ["head", "n_edges"]).select("id", "digest", "start", "n_edges", "n_places")


def remove_repeats(
    docs: DataFrame, k: int = 35, sieve_bits: int = 30, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", hot_places: int = 1_000
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, spans`` of every row, and the columns named in ``carry``.

    ``kept_text`` has the kept words joined by one space; ``spans`` are the repeated spans
    (first word, number of words, number of places).
    """
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null")).alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_or_empty(text_col)).alias("digest"),
        *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry) if c != text_col),
    )
    spans = confirmed_spans(cut(repeated_fragments(keyed.select("id", "digest", text_or_empty("text").alias("text")), k, sieve_bits, hot_places=hot_places)))
    # Rows of equal id and text hold the same spans.
    spans = spans.groupBy("id", "digest").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("n_edges") + k - 1).alias("n_words"), "n_places"))).alias("spans")
    )
    spans = cut(spans)
    # Texts without a span need not be moved: a bit table of the digests tells most of them.
    digests = spans.select(F.col("digest").alias("a")).distinct()  # copies of a text have one
    likely = docs.sparkSession.sparkContext.broadcast(bit_table(digests, bits_for(spans.count(), sieve_bits)))  # 2 ** sieve_bits / 8 bytes at most

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[held_in(likely.value, batch["digest"].to_numpy(np.int64).view(np.uint64))]

    moved = map_batches(keyed, choose, keyed.schema).join(spans, ["id", "digest"], "left").drop("id", "digest")
    kind = dict(docs.dtypes)[id_col]
    span = "array<struct<start: long, n_words: long, n_places: long>>"

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[low : low + 1000].reset_index(drop=True) for whole in batches for low in range(0, len(whole), 1000)):
            counts, removed, kept = [], [], []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                words = WORD_RE.findall(text or "")
                out, low = [], 0
                for span in () if spans is None else spans:
                    out += words[low : max(low, span["start"])]
                    low = max(low, span["start"] + span["n_words"])
                out += words[low:]
                counts.append(len(words))
                removed.append(len(words) - len(out))
                kept.append(" ".join(out))
            found = {"doc_id": batch["doc_id"], "n_words": counts, "n_removed": removed, "kept_text": kept, "spans": batch["spans"]}
            yield pd.DataFrame(found | {f"carried_{i}": batch["text" if c == text_col else f"carried_{i}"] for i, c in enumerate(carry)})

    schema = f"doc_id {kind}, n_words long, n_removed long, kept_text string, spans {span}"
    schema += "".join(f", carried_{i} {dict(docs.dtypes)[c]}" for i, c in enumerate(carry))
    def keep_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rest = batch[~held_in(likely.value, batch["digest"].to_numpy(np.int64).view(np.uint64))]
            yield from keep(iter([rest.assign(spans=None)]))

    out = map_batches(moved, keep, schema).union(map_batches(keyed, keep_rest, schema))
    return out.withColumnsRenamed({f"carried_{i}": c for i, c in enumerate(carry)})

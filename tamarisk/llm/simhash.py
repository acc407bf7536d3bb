"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits of a fingerprint are grouped into partitions, correlated bits together. If two
fingerprints differ in at most ``radius`` bits, then for thresholds t with sum(t + 1) =
radius + 1 some partition differs in at most its own t bits. The thresholds (-1: not looked
at) come from dynamic programming over the expected numbers of probes and candidates of each
partition, estimated from the bit frequencies of all distinct fingerprints. Each fingerprint
probes every value within a partition's threshold; candidates are verified on all bits.

Equal fingerprints are one node, so copies are never paired. Where more than ``crowd`` fingerprints
hold a partition value, each probe is first compared with the least and the greatest of them; these stars make
preliminary components, and further pairs are sought only between different ones. So a dense group costs
links in proportion to its members. A partition value held by more
than ``hot_values`` fingerprints is split by a second pigeonhole on the bits outside the
partition: at most ``radius`` differ, so of ``radius + 1`` groups one is equal.

Nulls: a null text has no word and gets fingerprint zero, which links like any other. A null
id takes part but is never a component's smallest id unless all its ids are null. Repeated
rows come back as often as they occur; rows that tie have one component. Very long texts are read whole,
65,536 shingles at a time. Columns beyond id and text are not read, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import cut, join_smaller, map_batches
from tamarisk.llm.components import connected_components

BITS = 64
#: Verifying a candidate costs about as much as so many probes.
CANDIDATE_COST = 8.0


def fingerprint(text: str, size: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles of the text, as an unsigned number."""
    import xxhash

    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every whole text; fp is the fingerprint as a signed long."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(text or "", size, seed) for text in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": found.view(np.int64)})

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(chosen, take, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


def bit_products(values: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, total = n + len(bits), total + bits.T @ bits
        yield pd.DataFrame({"n": [n], "together": [total.ravel()]})

    parts = values.select("fp").mapInPandas(count, "n long, together array<double>")
    rows = parts.select("n", F.posexplode("together").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    together = np.zeros(BITS * BITS)
    for r in rows:  # 4,096 rows whatever the number of fingerprints
        together[r["at"]] = r["x"]
    return (rows[0]["n"] if rows else 0), together.reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size, each grown from the most correlated bits left."""
    p = together.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    left, groups = list(range(BITS)), []
    for i in range(parts):
        size = (BITS * (i + 1)) // parts - (BITS * i) // parts
        group = [max(left, key=lambda b: (strength[b, left].max(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (strength[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def costs(n: int, p: np.ndarray, group: list[int], radius: int) -> list[float]:
    """Expected cost of thresholds -1 .. radius for one partition."""
    within = np.zeros(len(group) + 1)  # distribution of the distance of two random values
    within[0] = 1.0
    for b in group:
        differ = 2 * p[b] * (1 - p[b])
        within[1:] = within[1:] * (1 - differ) + within[:-1] * differ
        within[0] *= 1 - differ
    pairs = n * (n - 1) / 2 * np.cumsum(within)
    probes = np.cumsum([comb(len(group), t) for t in range(radius + 1)])
    return [0.0] + [float(n * probes[t] + CANDIDATE_COST * pairs[min(t, len(group))]) for t in range(radius + 1)]


def allocate(n: int, together: np.ndarray, radius: int, most_parts: int = 6) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, of least expected cost; thresholds of -1 are left out."""
    n = max(n, 1)  # a table without rows costs probes like any other
    p = together.diagonal() / n
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(2, most_parts + 1):
        groups = group_bits(n, together, parts)
        # least[s]: (cost, thresholds) of the groups so far with sum(t + 1) = s
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            cost = costs(n, p, group, radius)
            following: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in least.items():
                for t in range(-1, radius - s + 1):
                    if c + cost[t + 1] < following.get(s + t + 1, (float("inf"),))[0]:
                        following[s + t + 1] = (c + cost[t + 1], [*ts, t])
            least = following
        c, ts = least[radius + 1]
        if c < best[0]:
            best = (c, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _rows_of(values: DataFrame, plan: list[tuple[list[int], int]]) -> tuple[DataFrame, DataFrame]:
    """Index and probe rows ``fp, (component,) part, value`` of all fingerprints."""
    index, probes = [], []
    for i, (group, t) in enumerate(plan):
        whole = sum(1 << b for b in group)
        flips = [sum(1 << b for b in some) for k in range(t + 1) for some in combinations(group, k)]
        index.append(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(whole))).alias("value")))
        held = index[-1]["value"]
        probes += [F.struct(F.lit(i).alias("part"), held.bitwiseXOR(F.lit(_signed(m))).alias("value")) for m in flips]
    own = [c for c in ("fp", "component") if c in values.columns]
    return tuple(values.select(*own, F.explode(F.array(*x)).alias("k")).select(*own, "k.part", "k.value") for x in (index, probes))


def _near(a: str, b: str, radius: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def star_links(values: DataFrame, plan: list[tuple[list[int], int]], radius: int = 4, crowd: int = 16) -> DataFrame | None:
    """``a, b``: links of fingerprints with the least and the greatest of a crowded partition value; None without a crowd."""
    indexed, probing = _rows_of(values.select("fp"), plan)
    crowded = indexed.groupBy("part", "value").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    crowded = cut(crowded.where(F.col("n") > crowd).select("part", "value", F.array("low", "high").alias("ends")))
    if not crowded.limit(1).count():
        return None
    stars = join_smaller(probing, crowded, ["part", "value"], "inner").select(F.col("fp").alias("a"), F.explode("ends").alias("b"))
    return stars.where((F.col("a") != F.col("b")) & _near("a", "b", radius)).distinct()


def candidate_links(values: DataFrame, radius: int = 4, hot_values: int = 256, plan: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """``a, b`` (a < b): all pairs of distinct fingerprints that differ in at most ``radius`` bits.

    A pair may come back once for each partition that finds it. If ``values`` has a ``component``,
    these are pairs of different components, given as ``a, b`` of the components.
    """
    plan = plan or allocate(*bit_products(values), radius)
    grouped = "component" in values.columns
    indexed, probing = _rows_of(values, plan)
    keys = ["part", "value"]
    held = indexed.groupBy(*keys).agg(F.count("*").alias("held"), *([F.min("component").alias("least"), F.max("component").alias("most")] if grouped else []))
    hot = cut(held.where(F.col("held") > hot_values))
    if hot.limit(1).count():
        # Bits outside the partition, in radius + 1 groups; one of them is equal in every pair sought.
        def split(rows: DataFrame, probe: bool) -> DataFrame:
            masks = []
            for group, _ in plan:
                rest = [b for b in range(BITS) if b not in group]
                masks.append([_signed(sum(1 << b for b in rest[j :: radius + 1])) for j in range(radius + 1)])
            kept = F.array(*[
                F.struct(
                    F.lit(j).alias("sub"),
                    F.element_at(F.array(*[F.col("fp").bitwiseAND(F.lit(m[j])) for m in masks]), F.col("part") + 1).alias("sub_value"),
                )
                for j in range(radius + 1)
            ])
            whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("sub_value")))
            marked = join_smaller(rows, hot, keys, "left")
            if grouped and probe:  # a value that only the probe's own component holds has nothing to find
                marked = marked.where(F.col("held").isNull() | (F.col("least") != F.col("component")) | (F.col("most") != F.col("component")))
            marked = marked.withColumn("s", F.explode(F.when(F.col("held").isNull(), whole).otherwise(kept)))
            return marked.select(*rows.columns, "s.sub", "s.sub_value")

        indexed, probing, keys = split(indexed, False), split(probing, True), [*keys, "sub", "sub_value"]
    names = {"fp": "a", "component": "of_a"}, {"fp": "b", "component": "of_b"}
    left, right = probing.withColumnsRenamed(names[0]), indexed.withColumnsRenamed(names[1])
    pairs = left.join(right, [*(left[k] == right[k] for k in keys), F.col("a") < F.col("b"), _near("a", "b", radius), *([F.col("of_a") != F.col("of_b")] if grouped else [])])
    if grouped:
        return pairs.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct()
    return pairs.select("a", "b")


def linked(values: DataFrame, radius: int = 4, crowd: int = 16, hot_values: int = 256) -> DataFrame:
    """``fp, component`` of at least all fingerprints that link to another one; the component is its smallest fingerprint."""
    plan = allocate(*bit_products(values), radius)
    stars = star_links(values, plan, radius, crowd)
    if stars is None:
        return connected_components(candidate_links(values, radius, hot_values, plan)).withColumnRenamed("node", "fp")
    first = cut(connected_components(stars).select(F.col("node").alias("fp"), "component"))
    of_values = cut(join_smaller(values.select("fp"), first, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    merged = cut(connected_components(candidate_links(of_values, radius, hot_values, plan)).select(F.col("node").alias("component"), F.col("component").alias("into")))
    return join_smaller(of_values, merged, "component", "left").select("fp", F.coalesce("into", "component").alias("component"))


#: A fingerprint that more rows hold than this, and than this share of all rows, is looked up by broadcast: at most so many.
MANY_ROWS, MOST_BROADCAST = 500, 100_000


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    of_docs = cut(fingerprints(docs, size, seed, id_col, text_col))
    values = cut(of_docs.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    total = values.agg(F.sum("n")).first()[0] or 0
    merged = values.join(linked(values, radius), "fp").select("fp", "component", "first_id")
    least = merged.groupBy("component").agg(F.min("first_id").alias("least_id"))
    merged = merged.join(least, "component").select("fp", "least_id")
    of_values = cut(values.join(merged, "fp", "left").select("fp", "n", F.coalesce("least_id", "first_id").alias("component_id")))
    # Fingerprints of very many rows go to the rows, so that these stay spread; there are MOST_BROADCAST at most.
    many = F.col("n") > max(MANY_ROWS, total // MOST_BROADCAST)
    hot = F.broadcast(of_values.where(many).drop("n"))
    rest = of_docs.join(hot, "fp", "left_anti").join(of_values.where(~many).drop("n"), "fp")
    return of_docs.join(hot, "fp").unionByName(rest).select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp"):
    """A signed long as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import BROADCAST_ROWS, cut


#: Links that a task of the table of a round holds, about.
LINKS_A_TASK = 100_000


def _settled(edges: DataFrame, most: int | None = None) -> tuple[DataFrame, tuple]:
    """The links, checkpointed in as few parts as ``most`` of them need, with their number and a sum of their hashes."""
    out = cut(edges if most is None else edges.coalesce(most // LINKS_A_TASK + 1))
    n, hashes = out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return out, (n, hashes)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 1_000) -> DataFrame:
    """``node, component`` for every node of a link; the component is its smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest
    neighbour. Only minima are aggregated, so a node with very many links is combined before
    the shuffle; the number of links never grows, and rounds grow with the logarithm of the
    longest path; it is an error if ``max_rounds`` do not do. Links with a null end and self-links are left out.
    """
    edges, state = _settled(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    for _ in range(max_rounds):
        few = F.broadcast if 2 * state[0] <= BROADCAST_ROWS else lambda df: df  # a minimum for each node: two for each link at most
        both = edges.union(edges.select("v", "u"))
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.join(few(large.groupBy("u").agg(F.min("v").alias("m"))), "u").select("v", "m", "u")
        before = state
        edges, state = _settled(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .distinct(),
            state[0],
        )
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

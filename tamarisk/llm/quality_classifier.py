"""Histogram gradient-boosted trees over document statistics.

Training (``fit``): statistics of a bounded sample of labelled documents (``max_documents``, a
parameter) are cut into at most 64 quantile bins, and depth-wise trees are grown on gradient
histograms with the logistic loss. Scoring (``score``): all trees are flattened into parallel
arrays (feature, threshold, left child, leaf value) and every batch of documents walks all of
them at once with numpy, one level per step. Statistics come from the whole text alone.

Nulls: a null text counts as empty and gets a score like any other. Repeated rows get equal
scores. Very long texts are read whole. Other columns of the input are not read, whatever their
names. An empty table gives an empty result; without two classes in the sample the score is
the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import WORD_RE, map_batches
from tamarisk.llm.textstats import base_counts

STATS = (
    "n_words", "word_length", "symbol_share", "bar_share", "capital_share", "repeat_share", "dup_line_share", "distinct_share",
    "line_words", "digit_share", "exclaim_share", "stop_share", "comma_share", "adjacent_share", "line_chars", "white_share",
)


def document_stats(text: str) -> tuple[float, ...]:
    words = WORD_RE.findall(text)
    lines = text.split("\n")
    chars, symbols, dup, repeated = base_counts(text, words, lines)
    n, size = max(1, len(words)), max(1, len(text))
    return (
        float(len(words)),
        chars / n,
        symbols / size,
        text.count("|") / n,
        sum(map(str.isupper, words)) / n,
        repeated / n,
        dup / len(lines),
        len(set(words)) / n,
        n / len(lines),
        sum(map(text.count, "0123456789")) / size,
        text.count("!") / n,
        text.count(".") / n,
        text.count(",") / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        size / len(lines),
        text.count(" ") / size,
    )


def stats_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, the columns named, and the statistics as an array of doubles."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in ("doc_id", *more)] + ["stats array<double>"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["doc_id", *more]].copy()
            out["stats"] = [document_stats(text or "") for text in batch["text"]]
            yield out

    return map_batches(docs.select("doc_id", "text", *more), measure, schema)


class Trees(NamedTuple):
    """All trees in parallel arrays; ``roots`` are positions in them, a leaf has feature -1."""

    prior: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int


def grow(stats: np.ndarray, labels: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10) -> Trees:
    """Boosted trees on histograms of gradients; the right child stands next to the left one."""
    labels = labels.astype(float)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    prior = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return Trees(prior, np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0), depth)
    edges = [np.unique(np.quantile(stats[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(stats.shape[1])]
    binned = np.stack([np.searchsorted(e, stats[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    n_stats = stats.shape[1]
    offset = binned + np.arange(n_stats) * bins
    roots, feature, threshold, left, value = [], [], [], [], []
    margin = np.full(len(labels), prior)

    def node() -> int:
        for column, empty in ((feature, -1), (threshold, 0.0), (left, -1), (value, 0.0)):
            column.append(empty)
        return len(feature) - 1

    for _ in range(n_trees):
        chance = 1 / (1 + np.exp(-margin))
        gradient, weight = labels - chance, chance * (1 - chance)
        roots.append(top := node())
        level = [(top, np.arange(len(labels)))]
        for d in range(depth + 1):
            following = []
            for at, rows in level:
                g, h = gradient[rows].sum(), weight[rows].sum()
                value[at] = rate * g / (h + 1.0)
                margin[rows] += value[at] if d == depth else 0.0
                if d == depth:
                    continue
                flat = offset[rows].ravel()
                sums = [np.bincount(flat, np.repeat(x, n_stats), n_stats * bins).reshape(n_stats, bins).cumsum(1) for x in (gradient[rows], weight[rows], np.ones(len(rows)))]
                gain = sums[0] ** 2 / (sums[1] + 1) + (g - sums[0]) ** 2 / (h - sums[1] + 1) - g * g / (h + 1)
                gain[(sums[2] < least) | (len(rows) - sums[2] < least)] = -1
                for j, e in enumerate(edges):
                    gain[j, len(e) :] = -1
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] <= 1e-6:
                    margin[rows] += value[at]
                    continue
                feature[at], threshold[at] = int(j), float(edges[j][b])
                left[at] = node()
                node()
                low = binned[rows, j] <= b
                following += [(left[at], rows[low]), (left[at] + 1, rows[~low])]
            level = following
    return Trees(prior, np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(value), depth)


def walk(trees: Trees, stats: np.ndarray) -> np.ndarray:
    """Scores in 0..1 of many documents: all rows go down all trees together."""
    total = np.full(len(stats), trees.prior)
    if len(trees.roots) and len(stats):
        rows = np.arange(len(stats))[:, None]
        at = np.repeat(trees.roots[None, :], len(stats), axis=0)
        for _ in range(trees.depth):
            j = trees.feature[at]
            below = trees.left[at] + (stats[rows, np.maximum(j, 0)] > trees.threshold[at])
            at = np.where(j >= 0, below, at)
        total = total + trees.value[at].sum(1)
    return 1 / (1 + np.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = 6_000, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Train on at most ``max_documents`` labelled rows, chosen by digest of the id."""
    chosen = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_documents)
    )
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # max_documents rows of two numbers
    rows = stats_of(found, "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "stats").limit(max_documents).collect()
    return grow(np.array([r["stats"] for r in rows]).reshape(-1, len(STATS)), np.array([r["quality"] for r in rows]))


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every document."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stats = np.array([document_stats(text or "") for text in batch["text"]]).reshape(-1, len(STATS))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": walk(trees, stats)})

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(chosen, judge, f"doc_id {dict(docs.dtypes)[id_col]}, score double")

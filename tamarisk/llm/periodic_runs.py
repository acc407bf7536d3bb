"""Periodic runs of words, found by uniting suffix classes in descending order of their common length.

The words of a document are numbered; suffixes are ordered by prefix doubling, and neighbours in
that order know how many words they share. Kruskal's order over these lengths, the longest first,
unites classes of suffixes with union-find; each class holds its positions in order. Where a union
makes two positions i < j adjacent, and they lie no further apart than a third of the words they
share, the words from i repeat with period j - i. Seeds with the same period and end belong to one
run, whose start is the smallest of them: i and j meet exactly at their common length, so the end
is exact, and no smaller period is possible, since a position between them would have kept them
apart. Only windows of four words that occur again in their document take part, as a run of
exponent four shares at least five words with its own beginning.

A document is read whole by one task, whose working memory grows with that document; documents are
worked on in groups of some hundred thousand characters. Nothing is shuffled.

Nulls: a null text has no words. An empty text has no run and an empty kept text. Very long texts
are read whole. Ties of exponent go to the smallest start, then period. Repeated rows give repeated
results. An empty table gives an empty result. Columns other than id and text are not read, whatever
their names.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import WORD, WORD_RE, map_arrow, text_or_empty

#: A run has at least so many words, and at least so many of its periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that the beginning of every run shares with the same run one period later.
LEAST_COMMON = 5
#: Characters of the texts that are worked on together.
GROUP_CHARS = 1_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)

Run = tuple[int, int, int]


def repeated_windows(ids: np.ndarray) -> np.ndarray:
    """Positions whose window of four words may occur again (all that do, and rare others)."""
    if len(ids) < 5:
        return np.empty(0, np.int64)
    words = ids.astype(np.uint64)
    mixed = sum(words[k : len(ids) - 3 + k] * _MIX[k] for k in range(4))
    ordered = np.sort(mixed)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.empty(0, np.int64)
    return np.flatnonzero(again[np.minimum(np.searchsorted(again, mixed), len(again) - 1)] == mixed)


def suffix_classes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions in the order of their suffixes, and how many words each shares with the next (0 for less than four).

    ``ids``: the words of some documents one after the other, different documents without a number in common.
    """
    n = len(ids)
    ended = np.append(ids + 1, [0, 0, 0])
    pairs = np.unique(ended[:-1] * (n + 2) + ended[1:], return_inverse=True)[1]
    keys = pairs[:n] * (n + 3) + pairs[2:]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.append(True, keys[1:] != keys[:-1])[:n]
    rank = np.full(n + 1, -1, np.int32 if n < 2**31 - 1 else np.int64)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    levels, active = [(4, rank)], np.flatnonzero(~(first & np.append(first[1:], True)[:n]))
    while len(active):
        span, before = levels[-1]
        here = order[active]
        keys = before[here].astype(np.int64) * (n + 1) + before[here + span] + 1
        by = np.argsort(keys, kind="stable")
        order[active], keys = here[by], keys[by]
        first = np.append(True, keys[1:] != keys[:-1])
        rank = before.copy()
        rank[order[active]] = active[first][np.cumsum(first) - 1]
        levels.append((2 * span, rank))
        active = active[~(first & np.append(first[1:], True))]
    common = np.zeros(max(n - 1, 0), np.int64)
    near = np.flatnonzero(levels[0][1][order[:-1]] == levels[0][1][order[1:]])
    i, j, shared = order[near], order[near + 1], np.zeros(len(near), np.int64)
    for span, rank in reversed(levels):
        shared += span * (rank[i + shared] == rank[j + shared])
    going = np.ones(len(near), bool)
    for _ in range(3):
        going &= ended[i + shared] == ended[j + shared]
        shared += going
    common[near] = shared
    return order, common


def runs_in(ids: np.ndarray) -> list[Run]:
    """``start, length, period`` of every run, by start and period."""
    order, common = suffix_classes(ids)
    edges = np.flatnonzero(common >= LEAST_COMMON)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    place, parent = order.tolist(), list(range(len(order)))
    classes: dict[int, list[int]] = {}
    starts: dict[tuple[int, int], int] = {}

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    def adjacent(i: int, j: int, shared: int) -> None:
        if (LEAST_PERIODS - 1) * (j - i) <= shared:
            run = (j + shared, j - i)
            starts[run] = min(i, starts.get(run, i))

    for k, shared in zip(edges.tolist(), common[edges].tolist(), strict=True):
        a, b = find(k), find(k + 1)
        large, small = classes.pop(a, None) or [place[a]], classes.pop(b, None) or [place[b]]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        gaps = [bisect(large, p) for p in small]
        for t, (p, gap) in enumerate(zip(small, gaps, strict=True)):
            if gap and (not t or gaps[t - 1] != gap):
                adjacent(large[gap - 1], p, shared)
            if gap < len(large) and (t + 1 == len(small) or gaps[t + 1] != gap):
                adjacent(p, large[gap], shared)
        if len(small) == 1:
            large.insert(gaps[0], small[0])
        else:
            large += small
            large.sort()  # two ordered stretches are merged
        parent[b], classes[a] = a, large
    found = [(start, end - start, period) for (end, period), start in starts.items()]
    return sorted((s, n, p) for s, n, p in found if n >= max(LEAST_WORDS, LEAST_PERIODS * p))


def runs_of(texts: list[list[str]]) -> list[list[Run]]:
    """The runs of each of some lists of words. Only those with a window that occurs again are looked into."""
    numbered, count = [], 0
    for words in texts:
        known: dict[str, int] = {}
        numbered.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64) + count)
        count += len(known)
    firsts = np.cumsum([0, *map(len, numbered)])
    again = repeated_windows(np.concatenate([*numbered, np.empty(0, np.int64)]))
    chosen = np.unique(np.searchsorted(firsts, again, side="right") - 1).tolist()
    out: list[list[Run]] = [[] for _ in texts]
    if chosen:
        found = runs_in(np.concatenate([numbered[c] for c in chosen]))
        lows = np.cumsum([0, *(len(numbered[c]) for c in chosen)])
        for at, (start, length, period) in zip((np.searchsorted(lows, [r[0] for r in found], side="right") - 1).tolist(), found, strict=True):
            out[chosen[at]].append((start - int(lows[at]), length, period))
    return out


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length for its period, exactly; of equal ones the first."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words without all that lie in a run after its first period."""
    out, low = [], 0
    for start, length, period in sorted(runs, key=lambda r: r[0] + r[2]):
        out += words[low : max(low, start + period)]
        low = max(low, start + length)
    return out + words[low:]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch by characters of text; a longer text is a slice of its own."""
    low, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch["text"]).to_pylist()):
        if held and held + n > GROUP_CHARS:
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += n
    yield batch.slice(low)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, strongest, kept_text`` of every document.

    ``runs`` are all runs (start, length, period in words) by start and period, ``strongest`` the one
    with the greatest exponent (null: none), ``kept_text`` the words that no run repeats, joined by a space.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (g for b in batches for g in _groups(b)):
            texts = [WORD_RE.findall(t) for t in batch["text"].to_pylist()]
            runs = runs_of(texts)
            as_struct = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
            columns = {
                "doc_id": batch["doc_id"],
                "n_words": pa.array(list(map(len, texts)), pa.int64()),
                "runs": pa.array([[as_struct(r) for r in x] for x in runs], pa.list_(_RUN)),
                "strongest": pa.array([as_struct(strongest(x)) for x in runs], _RUN),
                "kept_text": pa.array([" ".join(collapsed(w, x) if x else w) for w, x in zip(texts, runs, strict=True)], pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    chosen = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    run = "struct<start: long, length: long, period: long>"
    return map_arrow(chosen, work, f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, runs array<{run}>, strongest {run}, kept_text string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of which a tenth (by a checksum h of the id) end periodically; the others, and those without id or word, stay.

    With g = h div 10 and n words, the words from a = g mod n on repeat the first 1 + (n - a) div (3 + g mod 8) of them.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = (h / 10).cast("long")

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = 1 + ((n - a) / (3 + g % 8)).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), F.slice(tail, 1, n - a)), " "))

    words = F.array(F.regexp_extract_all(text_col, F.lit(f"({WORD})"), F.lit(1)))
    return docs.withColumn(text_col, F.when(h % 10 == 0, F.coalesce(F.transform(words, planted)[0], F.col(text_col))).otherwise(F.col(text_col)))

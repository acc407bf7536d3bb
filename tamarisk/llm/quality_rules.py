"""Line sequence labelling: a linear-chain CRF marks each line content or boilerplate.

Training (``fit``): labels of lines that change within a document come from three sources.
Lines of labelled documents carry their document's quality label; *furniture* (menus, buttons,
dates, links, notices) is made from the words of the same documents; and *spliced* sequences
alternate runs of good lines with runs of bad lines or furniture, so that the chain learns
where a document changes. Features of the lines are made by Spark's tasks; at most
``max_segments`` segments of ``SEGMENT`` lines of at most ``max_documents`` labelled documents,
chosen by digest, go to the driver, whatever the length of the texts. A two-state chain is fitted
to them by gradient ascent on the conditional log-likelihood (forward-backward in numpy).

Labelling (``apply_rules``): Viterbi decoding of every line of every whole text, in one pass
over the documents without a shuffle; the texts of a batch walk side by side. A document is
kept if it passes the base counts and at least ``min_share`` of its words lie in content lines.

Nulls: a null text counts as empty; it has no words, so it fails the base rule. Repeated
rows are judged alike. A line whose two labels score alike is content. Very long texts are read
whole, one step for each line. An empty table gives an empty result, an empty or missing sample
gives the prior weights. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from random import Random
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import WORD_RE, map_batches
from tamarisk.llm.language import best_paths
from tamarisk.llm.textstats import base_counts

FEATURES = (
    "bias", "symbols", "any_symbol", "capitals", "bars", "log_words", "word_length", "short", "ends",
    "seen_before", "repeated_words", "digits", "exclaims", "link", "titles", "marks", "begins_low", "commas",
)
#: Weights of "content" before training: symbols, capitals, tables and repeats speak against it.
PRIOR = (1.5, -4.0, -1.0, -2.0, -3.0, 0.2, 0.0, -0.3, 0.3, -2.0, -2.0, -1.0, -1.0, -1.0, -0.3, -1.0, 0.0, 0.2)
STAY, LEAVE = 0.6, -0.6
#: Lines of a training segment.
SEGMENT = 40


def line_features(line: str, words: list[str], seen: bool) -> tuple[float, ...]:
    n, size = len(words), max(1, len(line))
    symbols = sum(map(line.count, "#*$%&<>|"))
    letters = [c for c in line if c.isalpha()]
    capitals = sum(map(str.isupper, letters)) / max(1, len(letters))
    return (
        1.0,
        10.0 * symbols / size,
        float(symbols > 0),
        capitals,
        line.count("|") / max(1, n),
        float(np.log1p(n)),
        len(letters) / max(1, n) / 10,
        float(n < 4),
        float(line.rstrip()[-1:] in ".?!:;\"'»"),
        float(seen),
        max(0.0, 0.5 - len(set(words)) / max(1, n)),  # common words do repeat in prose
        max(0.0, sum(map(line.count, "0123456789")) / size - 0.1),
        line.count("!") / max(1, n),
        float("http" in line or "www." in line),
        sum(w[0].isupper() for w in words) / max(1, n),
        float(any(map(line.__contains__, "©®™@→»•·|"))),
        float(0 < n < 6 and words[0][0].islower()),
        min(0.1, line.count(",") / max(1, n)),
    )


def lines_of(text: str) -> tuple[list[int], np.ndarray]:
    """The numbers of words of the lines that have one, and the features of these lines."""
    seen: set[str] = set()
    sizes, rows = [], []
    for line in text.split("\n"):
        if own := WORD_RE.findall(line):
            rows.append(line_features(line, own, line in seen))
            seen.add(line)
            sizes.append(len(own))
    return sizes, np.array(rows, dtype=float).reshape(-1, len(FEATURES))


def content_lines(scores: np.ndarray, lengths: np.ndarray, stay: float, leave: float) -> np.ndarray:
    """Best labels of the lines of many texts, one after the other, for the scores of content over boilerplate."""
    return best_paths(np.stack([scores, np.zeros_like(scores)], axis=1), lengths, max(0.0, stay - leave)) == 0


def furniture(words: list[str], rng: Random, n: int) -> list[str]:
    """Lines as they stand around articles, made from the words given."""
    plain = [w for w in (w.strip(".,;:!?#*$%&|") for w in words) if w] or ["x"]
    pick = lambda low, high: [rng.choice(plain) for _ in range(rng.randint(low, high))]
    titles = lambda low, high: [w.capitalize() for w in pick(low, high)]
    kinds = (
        lambda: " ".join(titles(1, 4)),
        lambda: f" {rng.choice('|»·•/>')} ".join(" ".join(titles(1, 2)) for _ in range(rng.randint(2, 7))),
        lambda: " ".join(pick(1, 5)).upper() + rng.choice(["", "!", "!!"]),
        lambda: f"{' '.join(titles(1, 2))} {rng.randint(1, 40)} {rng.choice(plain)} {rng.randint(1, 99)}",
        lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)} {rng.randint(0, 23)}:{rng.randint(10, 59)}",
        lambda: f"© {rng.randint(1990, 2030)} {' '.join(titles(1, 3))}" + rng.choice(["", ". " + " ".join(titles(2, 4)) + "."]),
        lambda: " ".join(f"{w} ({rng.randint(1, 900)})" for w in titles(1, 4)),
        lambda: rng.choice(["https://", "www."]) + ".".join(w.lower() for w in pick(2, 3)) + "/" + rng.choice(plain).lower(),
        lambda: " ".join(pick(1, 3)) + rng.choice([" »", "...", " >>", "", ":"]),
    )
    return [rng.choice(kinds)() for _ in range(n)]


def segments_of(text: str, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of the lines of a text in segments, each with as many of furniture made from its words."""
    rng, feats = Random(seed), lines_of(text)[1]
    words = WORD_RE.findall(text)
    out = []
    for low in range(0, len(feats), SEGMENT):
        part = feats[low : low + SEGMENT]
        made = furniture(words, rng, max(4, len(part)))
        out.append((part, np.array([line_features(x, WORD_RE.findall(x), False) for x in made], dtype=float)))
    return out


def spliced(good: list[np.ndarray], bad: list[np.ndarray], rng: np.random.Generator, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences of runs of good and bad lines by turns, with a label for each line."""
    out = []
    for _ in range(n if good and bad else 0):
        state, parts, labels = int(rng.integers(2)), [], []
        for _ in range(int(rng.integers(2, 6))):
            source = (bad, good)[state]
            own = source[rng.integers(len(source))]
            low, size = int(rng.integers(len(own))), int(rng.geometric(0.25))
            parts.append(own[low : low + size])
            labels.append(np.full(len(parts[-1]), state))
            state = 1 - state
        out.append((np.concatenate(parts), np.concatenate(labels)))
    return out


def train(sample: list[tuple[str, int]], seed: int = 5) -> tuple[np.ndarray, float, float]:
    """``train_segments`` on the texts and labels of documents."""
    rows = [(part, made, label) for text, label in sample for part, made in segments_of(text, crc32(text.encode("utf-8", "surrogatepass")))]
    return train_segments(rows, seed)


def train_segments(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 5) -> tuple[np.ndarray, float, float]:
    """Train on segments (features of lines, of furniture, label) as they are and spliced."""
    good, bad = [x for x, _, y in rows if y], [x for x, _, y in rows if not y]
    if not good or not bad:
        return np.array(PRIOR), STAY, LEAVE
    rng = np.random.default_rng(seed)
    made = [m for _, m, y in rows if y]
    plain = [(x, np.ones(len(x), int)) for x in good] + [(x, np.zeros(len(x), int)) for x in bad]
    kinds = np.array([int(y[0]) for _, y in plain])
    mixed = spliced(good, bad, rng, len(rows) // 2) + spliced(good, made, rng, len(rows) // 2)
    share = np.concatenate([0.5 / np.bincount(kinds, minlength=2)[kinds], np.full(len(mixed), 1 / max(1, len(mixed)))])
    return chain_weights(plain + mixed, share)


def chain_weights(
    sequences: list[tuple[np.ndarray, np.ndarray]], share: np.ndarray, rounds: int = 100, rate: float = 0.3, penalty: float = 2e-3
) -> tuple[np.ndarray, float, float]:
    """Weights, stay and leave scores that maximise the conditional likelihood of labelled sequences, each with its share."""
    weights, stay, leave = np.array(PRIOR), STAY, LEAVE
    longest = max(len(x) for x, _ in sequences)
    feats = np.zeros((len(sequences), longest, len(FEATURES)))
    mask, gold = np.zeros((len(sequences), longest), dtype=bool), np.zeros((len(sequences), longest), dtype=int)
    for i, (x, y) in enumerate(sequences):
        feats[i, : len(x)], mask[i, : len(x)], gold[i, : len(x)] = x, True, y
    by_line = share / mask.sum(1)  # a long sequence counts like a short one
    pairs = mask[:, 1:]
    stays = ((gold[:, 1:] == gold[:, :-1]) & pairs).astype(float)
    moments = [np.zeros(len(FEATURES) + 2), np.zeros(len(FEATURES) + 2)]
    for step in range(1, rounds + 1):
        emit, alpha, beta, total = forward_backward(feats @ weights, mask, stay, leave)
        one = np.exp(np.minimum(0, alpha[:, :, 1] + beta[:, :, 1] - total[:, None])) * mask
        grad = np.einsum("ij,ijk->k", (gold * mask - one) * by_line[:, None], feats)
        kept = sum(np.exp(np.minimum(0, alpha[:, :-1, s] + stay + emit[:, 1:, s] + beta[:, 1:, s] - total[:, None])) for s in (0, 1))
        grad_stay = ((stays - kept) * pairs * by_line[:, None]).sum()
        full = np.concatenate([grad - penalty * weights, [grad_stay - penalty * stay, -grad_stay - penalty * leave]])
        moments[0] = 0.9 * moments[0] + 0.1 * full
        moments[1] = 0.99 * moments[1] + 0.01 * full**2
        move_by = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8) / np.sqrt(step)
        weights, stay, leave = weights + move_by[:-2], float(np.clip(stay + move_by[-2], 0, 3)), float(np.clip(leave + move_by[-1], -3, 0))
    return weights, stay, leave


def forward_backward(scores: np.ndarray, mask: np.ndarray, stay: float, leave: float) -> tuple[np.ndarray, ...]:
    """Emissions, forward and backward log sums and the log partition of many masked chains."""
    longest = scores.shape[1]
    emit = np.stack([np.zeros_like(scores), scores], axis=2)
    move = np.array([[stay, leave], [leave, stay]])
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    alpha[:, 0] = emit[:, 0]
    for t in range(1, longest):
        after = np.logaddexp(alpha[:, t - 1, 0, None] + move[0], alpha[:, t - 1, 1, None] + move[1]) + emit[:, t]
        alpha[:, t] = np.where(mask[:, t, None], after, alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        x = beta[:, t + 1] + emit[:, t + 1]
        before = np.logaddexp(x[:, 0, None] + move[:, 0], x[:, 1, None] + move[:, 1])
        beta[:, t] = np.where(mask[:, t + 1, None], before, beta[:, t + 1])
    return emit, alpha, beta, np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])


def fit(
    docs: DataFrame, labels: DataFrame, max_documents: int = 600, max_segments: int = 800, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[np.ndarray, float, float]:
    """Train on segments of whole texts of labelled documents; both bounds choose by digest."""
    chosen = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_documents)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # two numbers each

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, quality in zip(batch["text"], batch["quality"], strict=True):
                seed = crc32((text or "").encode("utf-8", "surrogatepass"))
                for i, (part, made) in enumerate(segments_of(text or "", seed)):
                    rows.append((crc32(f"{seed} {i}".encode()), int(quality), part.ravel().tolist(), made.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["lot", "quality", "lines", "made"])

    parts = map_batches(texts, measure, "lot long, quality int, lines array<double>, made array<double>")
    rows = parts.orderBy("lot", "quality", "lines").limit(max_segments).collect()
    shaped = lambda x: np.array(x).reshape(-1, len(FEATURES))
    return train_segments([(shaped(r["lines"]), shaped(r["made"]), r["quality"]) for r in rows])


def apply_rules(
    docs: DataFrame,
    model: tuple[np.ndarray, float, float],
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_share: float = 0.5,
    lines: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Counts, base rule, content share and verdict of every document (and ``line_labels``: 1 for content, by lines with a word)."""
    weights, stay, leave = np.asarray(model[0]), float(model[1]), float(model[2])
    schema = (
        f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double"
        + (", line_labels array<int>" if lines else "")
    )

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [text or "" for text in batch["text"]]
            found = [lines_of(text) for text in texts]
            lengths = np.array([len(sizes) for sizes, _ in found])
            scores = np.concatenate([feats @ weights for _, feats in found]) if found else np.zeros(0)
            paths = np.split(content_lines(scores, lengths, stay, leave), np.cumsum(lengths)[:-1])
            rows = []
            for text, (sizes, _), path in zip(texts, found, paths, strict=True):
                words = WORD_RE.findall(text)
                counts = base_counts(text, words, text.split("\n"))
                share = int(np.array(sizes)[path].sum()) / len(words) if words else 0.0
                failed = len(words) < min_words or 100 * counts[3] > max_repeat_percent * len(words)
                out_lines = (len(sizes), int(path.sum()), share)
                rows.append((len(words), *counts, failed, not failed and share >= min_share, *out_lines, *([path.astype(int).tolist()] if lines else [])))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")[1:]])
            out.insert(0, "doc_id", batch["doc_id"].values)
            yield out

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), judge, schema)

"""Language of whole texts: script ranges, word scores and a Viterbi pass with a switching penalty.

Training (``fit``): a bounded sample of labelled documents (about ``per_language`` for each
language, chosen by digest) gives counts of letter n-grams, hashed into ``SLOTS`` slots, and
the scripts each language is written in. A word's score for a language is the mean
log-likelihood of its n-grams times a weight that grows with its length; languages that do not use the
word's script are ruled out by its code points before any score is read.

Labelling (``identify``): the words of every whole text are labelled by the best path through
their scores, where each change of language costs ``penalty``. Many texts walk side by side,
one numpy step for each word position. The language with most letters is the prediction; its
share of the letters times the posterior of its spans is the score. The labelled spans can be returned.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Repeated rows are labelled
alike. Of languages that tie, the first by name is taken. Very long texts are read whole, one step
for each word. Other columns of the input are not read, whatever their names. An empty table
gives an empty result; without any labelled text all is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import map_batches

SLOTS = 1 << 15
CACHED_WORDS = 100_000
#: Words that are scored together.
SLAB = 40_000
#: First code points of script ranges (fixed values of the Unicode charts); a range ends where the next starts.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"),
    (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF00, "Latin"), (0x10000, "Other"), (0x20000, "Han"),
)
_STARTS = np.array([start for start, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_NUMBERS = np.array([_NAMES.index(name) for _, name in SCRIPTS])
_LETTERS = re.compile(r"[^\W\d_]+")


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Script numbers of code points."""
    return _SCRIPT_NUMBERS[np.searchsorted(_STARTS, points, side="right") - 1]


def n_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the letter 1- to 3-grams of all words and of the words themselves, the word that each
    belongs to, and the first code point of each word. Words stand between two markers."""
    points = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    opens, closes = points == ord("<"), points == ord(">")
    word = np.cumsum(opens) - 1
    starts = np.nonzero(opens)[0]
    odd = np.uint64(0x9E3779B97F4A7C15)
    one, two = points[:-1] * odd + np.uint64(1), (points[:-1] * odd + points[1:]) * odd + np.uint64(2)
    three = ((points[:-2] * odd + points[1:-1]) * odd + points[2:]) * odd + np.uint64(3)
    place = np.arange(len(points), dtype=np.uint64) - starts.astype(np.uint64)[word]
    whole = np.add.reduceat(_mixed((points * odd) ^ (place * np.uint64(0xD1342543DE82EF95))), starts)
    kept = ~(opens | closes)[:-1], ~closes[:-1], ~(closes[:-2] | closes[1:-1])
    hashes = np.concatenate([one[kept[0]], two[kept[1]], three[kept[2]], whole])
    owner = np.concatenate([word[:-1][kept[0]], word[:-1][kept[1]], word[:-2][kept[2]], np.arange(len(words))])
    return (_mixed(hashes) % np.uint64(SLOTS)).astype(np.int64), owner, points[starts + 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def letters_in(word: str) -> int:
    return len(word) if word.isalpha() else sum(map(str.isalpha, word))


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # slots x languages: log-likelihoods against the mean of all languages
    uses: np.ndarray  # scripts x languages: 0 or minus infinity


def fit(docs: DataFrame, per_language: int = 300, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Counts from about ``per_language`` whole documents of each language, summed up on Spark."""
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    held = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(label_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(held)
    if not languages:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros((len(_NAMES), 0), np.float32))
    rate = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / held[k]))]), F.col(label_col))
    lot = F.pmod(F.xxhash64(id_col, F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.where(lot < rate).select(F.col(label_col).alias("lang"), F.col(text_col).alias("text"))
    place = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(languages), SLOTS + len(_NAMES)))
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if words := _LETTERS.findall(text.lower()):
                    grams, _, first = n_grams(words)
                    total[place[lang], :SLOTS] += np.bincount(grams, minlength=SLOTS)
                    total[place[lang], SLOTS:] += np.bincount(scripts_of(first), minlength=len(_NAMES))
        at = np.nonzero(total.ravel())[0]
        yield pd.DataFrame({"at": at, "n": total.ravel()[at]})

    rows = map_batches(sample, count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(languages) * (SLOTS + len(_NAMES)))
    for r in rows:  # a row for each used slot and language at most
        total[r["at"]] = r["n"]
    total = total.reshape(len(languages), -1)
    grams, scripts = total[:, :SLOTS].T + 0.3, total[:, SLOTS:].T
    logs = np.log(grams / grams.sum(0))
    share = scripts / np.maximum(1, scripts.sum(0))
    return Model(languages, (logs - logs.mean(1, keepdims=True)).astype(np.float32), np.where(share >= 0.01, 0, -np.inf).astype(np.float32))


class WordScores:
    """Scores of words for all languages and their numbers of letters, kept for the words seen."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.letters = np.zeros(0, np.int32)

    def of(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words; new ones are scored together."""
        numbers = self.numbers
        at = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
        if len(numbers) > len(self.scores):
            new = list(islice(numbers, len(self.scores), None))
            grams, owner, first = n_grams(new)
            size = np.bincount(owner, minlength=len(new))
            weight = np.minimum(8, 1 + np.array(list(map(len, new)))) / size
            own = np.stack([np.bincount(owner, x[grams], minlength=len(new)) * weight for x in self.model.scores.T] or [np.zeros(len(new))], axis=1)
            allowed = self.model.uses[scripts_of(first)]
            # A script that no language uses rules nothing out.
            own = np.where((allowed == 0).any(1, keepdims=True), own + np.nan_to_num(allowed, neginf=-50.0), own)
            letters = np.array(list(map(letters_in, new)), np.int32)
            self.scores = np.concatenate([self.scores, np.where(letters[:, None] > 0, own, 0)[:, : self.scores.shape[1]].astype(np.float32)])
            self.letters = np.concatenate([self.letters, letters])
        return at


def best_paths(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of all words of many texts; ``scores`` has the words of one text after those of another."""
    n, k = scores.shape
    path = np.zeros(n, np.int32)
    if not n:
        return path
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1))  # texts with a t-th word
    stays, tops = np.zeros((n, k), bool), np.zeros(n, np.int32)
    best = scores[starts[: active[0]]].astype(np.float64)
    final = np.zeros(len(sizes), np.int32)
    for t in range(1, int(sizes[0]) + 1):
        now = int(active[t]) if t < sizes[0] else 0
        final[now : len(best)] = best[now:].argmax(1)
        if not now:
            break
        best = best[:now]
        at = starts[:now] + t
        top = best.argmax(1)
        switch = best[np.arange(now), top] - penalty
        stay = best >= switch[:, None]
        stays[at], tops[at] = stay, top
        best = np.where(stay, best, switch[:, None]) + scores[at]
    state = final
    for t in range(int(sizes[0]) - 1, -1, -1):
        now = int(active[t])
        at = starts[:now] + t
        own = state[:now]
        path[at] = own
        state[:now] = np.where(stays[at, own] | (t == 0), own, tops[at])
    return path


def identify(
    docs: DataFrame, model: Model, penalty: float = 6.0, spans: bool = False, carry: tuple[str, ...] = (),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, lang_pred, score, n_words, n_letters`` (and ``spans``: language, first word, number of words).

    The columns named in ``carry`` come along unchanged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of slots for each language
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double, n_words long, n_letters long"
    schema += "".join(f", carried_{i} {dict(docs.dtypes)[c]}" for i, c in enumerate(carry))
    if spans:
        schema += ", spans array<struct<lang: string, start: int, n_words: int>>"

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        scorer = WordScores(model)  # of this task alone: workers live on and would keep its memory
        names = np.array([*model.languages, "und"], dtype=object)
        k = len(model.languages)
        for whole in batches:
            for low in range(0, len(whole), 500):
                batch = whole.iloc[low : low + 500]
                texts = [_LETTERS.findall((text or "").lower()) for text in batch["text"]]
                lengths = np.array(list(map(len, texts)), dtype=np.int64)
                flat = list(chain.from_iterable(texts))
                scores, letters = np.zeros((len(flat), k), np.float32), np.zeros(len(flat), np.int32)
                for part in range(0, len(flat), SLAB):
                    if len(scorer.numbers) > CACHED_WORDS:
                        scorer.clear()
                    at = scorer.of(flat[part : part + SLAB])
                    scores[part : part + len(at)], letters[part : part + len(at)] = scorer.scores[at], scorer.letters[at]
                ends = np.cumsum(lengths)
                path = best_paths(scores, lengths, penalty) if k else np.zeros(len(scores), np.int32)
                rows = np.repeat(np.arange(len(batch)), lengths)
                held = np.zeros((len(batch), max(k, 1)))
                held = np.bincount(rows * max(k, 1) + path, letters, minlength=held.size).reshape(held.shape)
                total = held.sum(1)
                pick = held.argmax(1)
                # How sure the spans of the predicted language are, against all others.
                own = path == pick[rows]
                sums = np.stack([np.bincount(rows[own], scores[own, j], minlength=len(batch)) for j in range(k)] or [np.zeros(len(batch))], axis=1)
                chances = np.exp(sums - sums.max(1, keepdims=True))
                posterior = chances[np.arange(len(batch)), pick] / chances.sum(1)
                known = (total > 0) & (k > 0)
                share = held[np.arange(len(batch)), pick] / np.maximum(total, 1)
                out = pd.DataFrame({
                    "doc_id": batch["doc_id"].values,
                    "lang_pred": names[np.where(known, pick, k)],
                    "score": np.where(known, share * posterior, 0.0),
                    "n_words": lengths,
                    "n_letters": total.astype(np.int64),
                })
                for i, c in enumerate(carry):
                    out[f"carried_{i}"] = batch["text" if c == text_col else f"carried_{i}"].values
                if spans:
                    out["spans"] = [runs(path[e - n : e], names) for n, e in zip(lengths, ends, strict=True)]
                yield out

    carried = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry) if c != text_col]
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried)
    return map_batches(chosen, label, schema).withColumnsRenamed({f"carried_{i}": c for i, c in enumerate(carry)})


def runs(path: np.ndarray, names: np.ndarray) -> list[dict]:
    """Spans of equal labels."""
    if not len(path):
        return []
    starts = np.concatenate([[0], np.nonzero(np.diff(path))[0] + 1, [len(path)]])
    return [{"lang": names[path[s]], "start": int(s), "n_words": int(e - s)} for s, e in zip(starts, starts[1:], strict=False)]

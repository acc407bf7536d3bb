"""Counts over one whole text, for quality rules and the quality classifier."""

from __future__ import annotations

from collections import Counter

from tamarisk.llm.common import WORD_RE

SYMBOLS = "#*$%&|<>"


def repeat_words(words: list[str]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, last = Counter(windows), 0, -1
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + 3 - max(at, last)
            last = at + 3
    return covered


def base_counts(text: str, words: list[str], lines: list[str]) -> tuple[int, int, int, int]:
    """``word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    full = [line for line in lines if WORD_RE.search(line)]
    return (
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(full) - len(set(full)),
        repeat_words(words),
    )

"""Counting n-grams the plain way, for brute-force checks of the metrics."""

from __future__ import annotations

from collections import Counter


def ngrams(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def match_counts(h, r, max_n):
    return [sum((ngrams(h, n) & ngrams(r, n)).values()) for n in range(1, max_n + 1)]

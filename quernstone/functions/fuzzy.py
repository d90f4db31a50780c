"""Indel similarity (0..100) of texts and of phrases with windows of token lists, in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 85.0


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


@lru_cache(maxsize=200_000)
def ratio(a: str, b: str) -> float:
    """200 * LCS / (len a + len b); two empty texts are equal."""
    if a == b:
        return 100.0
    return 200.0 * common_length(a, b) / (len(a) + len(b))


def best_window(tokens: list[str], phrase: str, threshold: float = THRESHOLD) -> tuple[int, int] | None:
    """(first, last) place of the phrase in the tokens: the first equal window, else the earliest of the most similar at or
    above the threshold. A phrase of more words than there are tokens, or of none, is nowhere."""
    words = phrase.split()
    m, n = len(words), len(tokens)
    if not 0 < m <= n:
        return None
    want = " ".join(words)
    windows = [" ".join(tokens[i : i + m]) for i in range(n - m + 1)]
    if want in windows:
        i = windows.index(want)
        return i, i + m - 1
    best, at, letters = 0.0, None, set(want)
    for i, w in enumerate(windows):
        # what the lengths, and the letters that the window lacks, allow at most
        most = min(len(w), len(want) - len(letters.difference(w)))
        if 200.0 * most / (len(w) + len(want)) < max(threshold, best):
            continue
        r = ratio(w, want)
        if r >= threshold and r > best:
            best, at = r, i
    return None if at is None else (at, at + m - 1)


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
def window_udf(tokens: pd.Series, phrase: pd.Series) -> pd.DataFrame:
    got = [None if t is None or p is None else best_window(["" if x is None else x for x in t], p) for t, p in zip(tokens, phrase)]
    return pd.DataFrame({"start": [g[0] if g else None for g in got], "end": [g[1] if g else None for g in got]}).astype("Int32")


def ratios(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` plus ratio; every distinct pair is scored once."""
    scored = pairs.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct().withColumn("ratio", ratio_udf(a, b))
    return pairs.join(scored, [a, b], "left")

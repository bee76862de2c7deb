"""String similarities that built-in functions do not have, as Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    right = [c for c, f in zip(b, free, strict=True) if not f]
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def _winkler(a: str, b: str, scale: float = 0.1, least: float = 0.7) -> float:
    """Jaro similarity, raised for up to four equal leading characters where it is above ``least``."""
    s = _jaro(a, b)
    if s <= least:
        return s
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return s + same * scale * (1 - s)


def _matched(a: str, b: str) -> int:
    """Characters in the longest common substring and, on either side of it, in the next ones."""
    if not a or not b:
        return 0
    best, at, to = 0, 0, 0
    before = [0] * (len(b) + 1)
    for i, c in enumerate(a):
        now = [0] * (len(b) + 1)
        for j, d in enumerate(b):
            if c == d:
                now[j + 1] = before[j] + 1
                if now[j + 1] > best:
                    best, at, to = now[j + 1], i + 1 - now[j + 1], j + 1 - now[j + 1]
        before = now
    return best and best + _matched(a[:at], b[:to]) + _matched(a[at + best :], b[to + best :])


def _pairwise(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def jaro_winkler(a, b):
    """Jaro-Winkler similarity of two string columns; null if one is null."""
    return _pairwise(_winkler)(a, b)


def ratcliff_obershelp(a, b):
    """Twice the matched characters over all characters; 1 for two empty strings."""
    return _pairwise(lambda x, y: 2 * _matched(x, y) / (len(x) + len(y)) if x or y else 1.0)(a, b)

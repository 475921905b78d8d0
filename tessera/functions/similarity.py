"""String similarities that Spark lacks, as Arrow UDFs over batches of pairs; each distinct pair is computed once.

Definitions are the published ones: indel similarity 100 * 2 * LCS / (|a| + |b|); Jaro-Winkler with prefix weight 0.1 up to
four characters, 1 for two empty strings; the token variants sort, or split into common and differing, the distinct tokens.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for k, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 * 2 * lcs(a, b) / n if n else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best indel similarity among common tokens and common plus each side's own; 0 without tokens, 100 if one
    side's tokens are all common."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    base, one, two = " ".join(both), " ".join([*both, *left]), " ".join([*both, *right])
    return max(ratio(one, two), *([ratio(base, one), ratio(base, two)] if both else [0.0]))


def partial_ratio(a: str, b: str) -> float:
    """The best indel similarity of the shorter string and a stretch of the longer of at most its length."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    cuts = [b[max(0, k) : k + n] for k in range(1 - n, len(b))]
    return max(ratio(a, c) for c in cuts)


@lru_cache(maxsize=100_000)
def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, first = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                first.append(ch)
                break
    if not first:
        return 0.0
    second = [ch for ch, u in zip(b, used, strict=True) if u]
    m, moved = len(first), sum(x != y for x, y in zip(first, second, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return math.fma(0.1 * prefix, 1 - jaro, jaro) if jaro > 0.7 else jaro  # rounded once, as in DuckDB: comparisons see the last bit


def jaro_winkler_sql(a: str, b: str) -> float:
    """Jaro-Winkler as SQL has it: two empty strings have nothing in common and give 0."""
    return jaro_winkler(a, b) if a or b else 0.0


def _vectorized(f: Callable[[str, str], float]):
    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
        known = {p: f(*p) for p in set(pairs)}
        return pd.Series([known[p] for p in pairs], index=a.index, dtype="float64")

    return udf


FUNCTIONS = {"ratio": ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio, "partial_ratio": partial_ratio, "jaro_winkler": jaro_winkler, "jaro_winkler_sql": jaro_winkler_sql}


def udf(name: str):
    """The Arrow UDF of a similarity by name."""
    return _vectorized(FUNCTIONS[name])


def register(spark: SparkSession) -> None:
    """Makes all similarities SQL functions."""
    for name in FUNCTIONS:
        spark.udf.register(name, udf(name))

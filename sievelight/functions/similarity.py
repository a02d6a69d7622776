"""String similarities as Arrow-batched functions over two columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word a character of ``b`` (Hyyro, 2004)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    one, two = (f"{both} {s}".strip() for s in (left, right))
    gap = len(left) + len(right) - 2 * lcs(left, right)
    best = 1 - gap / (len(one) + len(two))
    return max(best, indel_ratio(both, one), indel_ratio(both, two)) if both else best


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, u in zip(b, used, strict=True) if u]
    m, moved = len(first), sum(x != y for x, y in zip(first, second, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _column(kernel):
    @pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        # values repeat within a batch: each pair of values is compared once
        seen: dict[tuple, float | None] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in seen:
                x, y = pair
                seen[pair] = None if x is None or y is None else 1.0 if x == y and x and kernel is not token_set_ratio else kernel(x, y)
            out.append(seen[pair])
        return pd.Series(out, dtype="float64")

    return run


fuzzy_ratio, token_sort, token_set, jaro_winkler_similarity = map(_column, (indel_ratio, token_sort_ratio, token_set_ratio, jaro_winkler))

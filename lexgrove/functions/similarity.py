"""The token-set ratio of two strings, and its longest-common-subsequence kernel.

Distinct white-space tokens are split into the common ones and what only either side
has; the ratio is the best of three normalised insertion-deletion similarities.
`ratio_of` takes both sides' sorted tokens and is native but for the LCS of what is left
over, which is bit-parallel over whole batches; `bound_of` is a native upper bound that
spares it most pairs.  `token_set_ratio` and `token_set_bound` take strings;
`token_set_ratio_native` is the whole ratio in Spark expressions, for cross-checks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

#: Pairs whose LCS is computed at once, and code points that a machine word has bits for.
TOGETHER, WORD = 4096, 64


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; one integer holds a whole row of the table."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _points(texts: list[str], width: int, filler: int) -> np.ndarray:
    out = np.full((len(texts), width), filler, np.uint32)
    sizes = np.array([len(t) for t in texts])
    out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """lcs of each pair; pairs whose shorter side fits a machine word go together, by length."""
    short, long = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]) if a else ((), ())
    sizes = np.array([len(x) for x in short], np.int64)
    out = np.zeros(len(short), np.int64)
    order = np.lexsort((np.array([len(y) for y in long], np.int64), sizes))
    fit = order[(sizes[order] > 0) & (sizes[order] <= WORD)]
    for i in order[sizes[order] > WORD].tolist():
        out[i] = lcs(short[i], long[i])
    for k in range(0, len(fit), TOGETHER):
        at = fit[k : k + TOGETHER].tolist()
        width, steps = int(sizes[at].max()), max(len(long[i]) for i in at)
        # fillers that match nothing
        left, right = _points([short[i] for i in at], width, 0xFFFFFFFF), _points([long[i] for i in at], steps, 0xFFFFFFFE)
        bits = np.uint64(1) << np.arange(width, dtype=np.uint64)
        full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(WORD) - sizes[at].astype(np.uint64))
        row = full.copy()
        with np.errstate(over="ignore"):
            for j in range(steps):
                hit = row & ((left == right[:, j, None]) * bits).sum(axis=1, dtype=np.uint64)
                row = ((row + hit) | (row - hit)) & full
        out[at] = sizes[at] - np.bitwise_count(row)
    return out


@F.pandas_udf(IntegerType())
def lcs_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(lcs_many(a.tolist(), b.tolist()), dtype="int32")


def ratio(x: str | None, y: str | None) -> float | None:
    """The token-set ratio, 0 to 100; null if either side is."""
    if x is None or y is None:
        return None
    left, right = set(x.split()), set(y.split())
    if not left or not right:
        return 0.0
    common = left & right
    only_left, only_right = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if common and not (only_left and only_right):
        return 100.0
    shared, a, b = len(" ".join(sorted(common))), len(only_left), len(only_right)
    gap = 1 if shared else 0
    first, second = shared + gap + a, shared + gap + b
    distance = a + b - 2 * lcs(only_left, only_right)
    best = 100.0 * (1 - distance / (first + second))
    if shared:
        best = max(best, 100.0 * (1 - (gap + a) / (shared + first)), 100.0 * (1 - (gap + b) / (shared + second)))
    return best


@F.pandas_udf(DoubleType())
def token_set_ratio(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([ratio(a, b) for a, b in zip(x, y)], dtype="float64")


def raw_tokens(c: Column | str) -> Column:
    """The distinct white-space tokens of a string, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")))


def left_over(left: Column, right: Column) -> tuple[Column, Column]:
    """What only either side has, joined by spaces."""
    return F.array_join(F.array_except(left, right), " "), F.array_join(F.array_except(right, left), " ")


def _from_lcs(left: Column, right: Column, common: Column | None) -> Column:
    a, b = (F.length(c) for c in left_over(left, right))
    shared = F.length(F.array_join(F.array_intersect(left, right), " "))
    gap = F.when(shared > 0, 1).otherwise(0)
    first, second = shared + gap + a, shared + gap + b
    if common is None:
        common = F.least(a, b)
    plain = 100.0 * (1 - (a + b - 2 * common) / (first + second))
    best = F.when(shared > 0, F.greatest(plain, 100.0 * (1 - (gap + a) / (shared + first)), 100.0 * (1 - (gap + b) / (shared + second)))).otherwise(plain)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).when((shared > 0) & ((a == 0) | (b == 0)), F.lit(100.0)).otherwise(best)


def bound_of(left: Column, right: Column) -> Column:
    """An upper bound of the ratio of two sides' sorted tokens: the shorter leftover counted as wholly common."""
    return _from_lcs(left, right, None)


def ratio_of(left: Column, right: Column) -> Column:
    """The ratio of two sides' sorted tokens."""
    return _from_lcs(left, right, lcs_lengths(*left_over(left, right)))


def token_set_bound(x: Column | str, y: Column | str) -> Column:
    return bound_of(raw_tokens(x), raw_tokens(y))


def token_set_ratio_native(x: Column | str, y: Column | str) -> Column:
    """The ratio in Spark expressions alone; slow on long strings."""
    left, right = raw_tokens(x), raw_tokens(y)
    only_left, only_right = left_over(left, right)
    start = F.array_repeat(F.lit(0), F.length(only_right) + 1)

    def row(before, c):
        return F.aggregate(
            F.sequence(F.lit(1), F.length(only_right)),
            F.array(F.lit(0)),
            lambda now, j: F.array_append(now, F.when(F.substr(only_right, j, F.lit(1)) == c, F.get(before, j - 1) + 1).otherwise(F.greatest(F.get(before, j), F.get(now, j - 1)))),
        )

    common = F.when((only_left == "") | (only_right == ""), F.lit(0)).otherwise(F.element_at(F.aggregate(F.split(only_left, ""), start, row), -1))
    return _from_lcs(left, right, common)

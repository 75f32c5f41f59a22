"""String similarity: indel ratios over token sets and sorted tokens, and trigram overlap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel over the first string."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 100 - 100 * (total - 2 * lcs_length(a, b)) / total


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of: common tokens against either side, and the two remainders behind the common tokens."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not only_x or not only_y):
        return 100.0
    gap = bool(common)
    long_x, long_y = len(common) + gap + len(only_x), len(common) + gap + len(only_y)
    share = lambda distance, length: 100 - 100 * distance / length if length else 100.0
    out = share(len(only_x) + len(only_y) - 2 * lcs_length(only_x, only_y), long_x + long_y)
    if common:
        out = max(out, share(gap + len(only_x), len(common) + long_x), share(gap + len(only_y), len(common) + long_y))
    return out


def _pairwise(f):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            r = known.get((x, y))
            if r is None:
                r = known[x, y] = f(x, y) / 100
            out.append(r)
        return pd.Series(out, dtype="float64")

    return run


def token_set(a: Column, b: Column) -> Column:
    """Token-set ratio from 0 to 1; null if either is null. Equal pairs of a batch are scored once."""
    return _pairwise(token_set_ratio)(a, b)


def token_sort(a: Column, b: Column) -> Column:
    return _pairwise(token_sort_ratio)(a, b)


def trigrams(x: Column) -> Column:
    """Distinct trigrams of the lower-case words, each padded with two blanks before and one after; JVM only."""
    words = F.filter(F.split(F.lower(x), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.try_divide(both, F.size(x) + F.size(y) - both)


def register(spark) -> None:
    """The similarity functions under their names, for SQL."""
    spark.udf.register("token_set_ratio", _pairwise(token_set_ratio))
    spark.udf.register("token_sort_ratio", _pairwise(token_sort_ratio))

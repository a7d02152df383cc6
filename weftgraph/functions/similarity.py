"""Similarities of vectors, sets and names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.shipping import by_value


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length; null, never NaN, for null and zero vectors, so that no threshold accepts them."""
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norm(a) * norm(b)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def softmax(scores: Column, temperature: float = 2.0) -> Column:
    """Of an array, with the maximum subtracted; a temperature of 0 or less means 1."""
    t = temperature if temperature > 0 else 1.0
    raised = let(F.struct(scores.alias("s"), F.array_max(scores).alias("top")), lambda a: F.transform(a["s"], lambda s: F.exp((s - a["top"]) / t)))
    summed = let(raised, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda s, y: s + y).alias("sum")))
    return let(summed, lambda a: F.transform(a["e"], lambda x: x / a["sum"]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))), F.lit(0.0))


def char_ngrams(text: Column, n: int = 3) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) < n, F.array(low)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substr(low, i, F.lit(n)))))


def name_similarity(a: str, b: str) -> float:
    """Jaro-Winkler of lower-cased names: prefix bonus of up to four characters at any score, half transpositions kept."""
    a, b = (a or "").lower(), (b or "").lower()
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    if not a or not b or reach < 0:
        return 0.0
    free = [True] * len(b)
    mine = []
    for i, ch in enumerate(a):
        at = next((j for j in range(max(0, i - reach), min(i + reach + 1, len(b))) if free[j] and b[j] == ch), -1)
        if at >= 0:
            free[at] = False
            mine.append(ch)
    m = len(mine)
    if not m:
        return 0.0
    other = [b[j] for j in range(len(b)) if not free[j]]
    swapped = sum(x != y for x, y in zip(mine, other)) / 2
    score = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return score + prefix * 0.1 * (1 - score)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Arrow-batched :func:`name_similarity`."""
    run = F.pandas_udf(_names, "double")
    return run(a, b)


def _names(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([name_similarity(x, y) for x, y in zip(a, b)], index=a.index, dtype="float64")


by_value(__name__)

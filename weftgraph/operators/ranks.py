"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucketed_rank(df: DataFrame, keys: list[str], unique: list[str], out: str, buckets: int = 1024) -> DataFrame:
    """``df`` with ``out``: 0-based numbers within ``keys``, in an arbitrary but reproducible order.

    Rows are numbered within (keys, hash bucket of ``unique``) and shifted by the counts of the buckets before, so a
    group of any size is spread over ``buckets`` tasks. ``unique`` names a row within its group.
    """
    b = df.withColumn("__b", F.pmod(F.xxhash64(*unique), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    numbered = b.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__b").orderBy(*unique)) - 1)
    same = [numbered[k].eqNullSafe(starts[k]) for k in [*keys, "__b"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = numbered.join(starts, cond)
    return joined.select(*[numbered[c] for c in df.columns], (F.col("__s") + F.col("__r")).cast("long").alias(out))


def ordered_rank(df: DataFrame, keys: list[str], order: list[Column], out: str, slice_of: Column) -> DataFrame:
    """``df`` with ``out``: 1-based numbers within ``keys`` by ``order``.

    ``slice_of`` must rise with ``order`` (a coarse, monotone function of its first column): numbering happens within
    (keys, slice) and is shifted by the counts of earlier slices, so one long group is spread over many tasks.
    """
    s = df.withColumn("__b", slice_of)
    counts = s.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy(F.col("__b").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    numbered = s.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__b").orderBy(*order)))
    cond = F.lit(True)
    for k in [*keys, "__b"]:
        cond = cond & numbered[k].eqNullSafe(starts[k])
    joined = numbered.join(starts, cond)
    return joined.select(*[numbered[c] for c in df.columns], (F.col("__s") + F.col("__r")).cast("long").alias(out))

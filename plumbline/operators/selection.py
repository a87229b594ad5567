"""Order statistics and exact top-k without sorting: histograms that are refined where the rank falls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a pass; a bucket of at most so many distinct values is read instead of being cut again.
LEVELS = 4096


def nth_smallest(df: DataFrame, value: str | Column, rank: int, levels: int = LEVELS) -> tuple[float, int, int] | None:
    """The value of the given rank (from 1) among the rows' numbers in order, how many are less, and how many are equal; None if there are
    not so many. Nulls and NaN don't count.

    A pass counts the values by bucket, at most ``levels`` rows with least and largest, and goes on with the bucket that has the rank; it
    ends when that bucket has one value. So tasks add up counts, and none holds a bucket's rows.
    """
    x = F.col(value) if isinstance(value, str) else value
    rows = df.select(x.cast("double").alias("x")).where("x is not null and not isnan(x)")
    n, low, high = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if rank < 1 or rank > n:
        return None
    below = 0
    while low < high:
        here = rows.where(F.col("x").between(low, high)).withColumn("bucket", F.least(F.floor((F.col("x") / 2 - low / 2) / (high / 2 - low / 2) * levels), F.lit(levels - 1)))
        parts = sorted(here.groupBy("bucket").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect())  # at most ``levels`` rows
        for part in parts:
            if below + part["n"] >= rank:
                break
            below += part["n"]
        low, high, n = part["low"], part["high"], part["n"]
    return low, below, n


def median(df: DataFrame, value: str | Column) -> float | None:
    """The middle value, or the mean of the two middle ones, interpolated as SQL's percentile_cont does; null for no rows."""
    x = F.col(value) if isinstance(value, str) else value
    n = df.where(x.isNotNull() & ~F.isnan(x.cast("double"))).count()
    if not n:
        return None
    one, below, equal = nth_smallest(df, x, (n + 1) // 2)
    if n % 2 or below + equal > (n + 1) // 2:
        return one
    other = nth_smallest(df, x, n // 2 + 1)[0]
    return one + (other - one) * 0.5


def smallest(df: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Exactly k rows of df, the smallest by the numeric columns ``by`` in turn (fewer if it has fewer; more only if rows tie in all of
    them). Where the limits fall is found by nth_smallest; the rows are then filtered where they are."""
    if k <= 0:
        return df.limit(0)
    limits, tied, left = [], df, k
    for c in by:
        found = nth_smallest(tied, c, left)
        if found is None:
            return df
        value, below, equal = found
        limits.append((c, value))
        left -= below
        if left == equal:
            break
        tied = tied.where(F.col(c) == value)
    last = len(limits) - 1
    within = reduce(lambda inner, at: (F.col(at[1][0]) < at[1][1]) | (F.col(at[1][0]) == at[1][1]) & inner if at[0] < last else F.col(at[1][0]) <= at[1][1], reversed(list(enumerate(limits))), F.lit(True))
    return df.where(within)

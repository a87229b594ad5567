"""Running totals and ranks that do not put a key's rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.lineage import checkpointed


def running_total(df: DataFrame, by: list[str], order: list[str | Column], value: str, out: str, stretch: Column | None = None, digits: int = 3) -> DataFrame:
    """df with ``out``: the sum of ``value`` over the rows of the key up to and including this one, by ``order``.

    ``stretch`` cuts each key's rows into stretches that follow the order; if it is not given, order[0] is a hex digest, whose
    first digits do. The stretches' sums (at most 16 ** digits a key) are totalled first; the window runs within a stretch only.
    """
    d = df.withColumn("__part", F.substring(order[0], 1, digits) if stretch is None else stretch)
    sums = d.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    base = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = W.partitionBy(*by, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return d.join(base, [*by, "__part"]).withColumn(out, F.col("__base") + F.sum(value).over(inside)).drop("__part", "__base")


def ranked(df: DataFrame, by: list[str], value: str | None, tie: str, out: str, levels: int = 512) -> DataFrame:
    """df with ``out``: the rank of each row within its key, from 1, by ``value`` ascending (if given) and then the hex digest ``tie``."""
    d = checkpointed(df.withColumn("__one", F.lit(1).cast("long")))  # read for the range of values, the sums and the ranks
    if value is None:
        return running_total(d, by, [tie], "__one", out).drop("__one")
    low, high = d.agg(F.min(value), F.max(value)).first()
    if low is None or low == high:
        return running_total(d, by, [tie], "__one", out).drop("__one")
    level = F.least(F.floor((F.col(value) - low) / (high - low) * levels), F.lit(levels - 1)).cast("int")
    return running_total(d, by, [F.col(value), F.col(tie)], "__one", out, stretch=F.lpad(level.cast("string"), 6, "0")).drop("__one")

"""Training histories and run states: running bests, early stopping, latest states, epoch means, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import clock, progress


def best_so_far(history: DataFrame, metric: str = "metric") -> DataFrame:
    """history (run, epoch, metric) with best_metric and best_epoch so far. A best must be above -1, strictly above the one before;
    until then they are -1 and 0. A null or NaN metric is never a best."""
    w = W.partitionBy("run").orderBy("epoch")
    m = F.when(F.isnan(F.col(metric).cast("double")), None).otherwise(F.col(metric).cast("double"))
    before = F.greatest(F.lit(-1.0), F.coalesce(F.max(m).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1.0)))
    d = history.withColumn("__new", F.coalesce(m > before, F.lit(False)))
    now = w.rowsBetween(W.unboundedPreceding, 0)
    return (
        d.withColumn("best_metric", F.greatest(F.lit(-1.0), F.coalesce(F.max(m).over(now), F.lit(-1.0))))
        .withColumn("best_epoch", F.coalesce(F.max(F.when(F.col("__new"), F.col("epoch"))).over(now), F.lit(0)))
        .drop("__new")
    )


def early_stop(history: DataFrame, patience: int, metric: str = "metric") -> DataFrame:
    """best_so_far with epochs_since_best (since the start where there is none yet) and stop: the first epoch at which patience is
    used up. Later epochs of a stopped run are left out."""
    w = W.partitionBy("run").orderBy("epoch")
    d = best_so_far(history, metric).withColumn("epochs_since_best", F.col("epoch") - F.col("best_epoch"))
    d = d.withColumn("__over", F.count_if(F.col("epochs_since_best") >= patience).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.where("__over <= 1").withColumn("stop", (F.col("__over") == 1) & (F.col("epochs_since_best") >= patience)).where("stop or __over = 0").drop("__over")


def latest_run(states: DataFrame) -> DataFrame:
    """The newest state over all runs, and how many runs there are. states: (run, updated_at, ...); ties to the larger run."""
    rest = [c for c in states.columns if c not in ("updated_at", "run")]
    return states.agg(F.max(F.struct("updated_at", "run", *rest)).alias("s"), F.countDistinct("run").alias("runs")).select("s.*", "runs").where("runs > 0")


def epoch_running_means(steps: DataFrame) -> DataFrame:
    """Means of loss by run and epoch, weighted by the batch size. steps: (run, epoch, loss, size)."""
    return steps.groupBy("run", "epoch").agg((F.sum(F.col("loss") * F.col("size")) / F.sum("size")).alias("mean_loss"), F.sum("size").alias("samples"))


def progress_fields(states: DataFrame) -> DataFrame:
    """states (step, steps_per_epoch, epoch, epochs, seconds_per_step) with batch and global percent, and the two ETAs as clocks."""
    done = (F.col("epoch") - 1) * F.col("steps_per_epoch") + F.col("step")
    total = F.col("epochs") * F.col("steps_per_epoch")
    return (
        states.withColumn("batch_percent", progress(F.col("step"), F.col("steps_per_epoch")))
        .withColumn("global_percent", progress(done, total))
        .withColumn("eta_epoch", clock(F.greatest(F.lit(0), F.col("steps_per_epoch") - F.col("step")) * F.col("seconds_per_step")))
        .withColumn("eta_total", clock(F.greatest(F.lit(0), total - done) * F.col("seconds_per_step")))
    )

"""Scores of a classifier's predictions: confusion, top-k, F1, balanced accuracy, reports and losses.

Predictions have target, pred and, where scores are needed, an array ``logits``. Confusion is sparse: (target, pred, n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import argmax, log_softmax, top_k


def with_prediction(scores: DataFrame) -> DataFrame:
    return scores.withColumn("pred", argmax("logits"))


def confusion_matrix(preds: DataFrame) -> DataFrame:
    return preds.groupBy("target", "pred").agg(F.count("*").alias("n"))


def topk_accuracy(scores: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row: top<k> in percent for each k; 0 for an empty table."""
    best = scores.select("target", top_k("logits", max(ks)).alias("best"))
    hit = lambda k: F.coalesce(F.avg(F.array_contains(F.slice("best", 1, k), F.col("target")).cast("double")) * 100, F.lit(0.0)).alias(f"top{k}")
    return best.agg(*map(hit, ks))


def class_counts(confusion: DataFrame) -> DataFrame:
    """(class_id, tp, support, predicted) of each class that occurs."""
    rows = confusion.select(F.expr("stack(2, target, n, 0L, pred, 0L, n) as (class_id, support, predicted)"), F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"))
    return rows.groupBy("class_id").agg((F.sum("tp") / 2).cast("long").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))


def macro_f1(confusion: DataFrame) -> DataFrame:
    """Mean of 2 tp / (support + predicted) over classes with support, in percent."""
    c = class_counts(confusion).where("support > 0")
    return c.agg(F.coalesce(F.avg(2 * F.col("tp") / (F.col("support") + F.col("predicted"))) * 100, F.lit(0.0)).alias("macro_f1"))


def balanced_accuracy(confusion: DataFrame) -> DataFrame:
    c = class_counts(confusion).where("support > 0")
    return c.agg(F.coalesce(F.avg(F.col("tp") / F.col("support")) * 100, F.lit(0.0)).alias("balanced_accuracy"))


def per_class_report(confusion: DataFrame, classes: DataFrame) -> DataFrame:
    """support, precision, recall and f1 (0 where undefined, 6 decimals) of every class of the dimension."""
    c = classes.join(class_counts(confusion), "class_id", "left").fillna(0, ["tp", "support", "predicted"])
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 6)
    tp, s, p = F.col("tp"), F.col("support"), F.col("predicted")
    return c.select("class_id", "support", share(tp, p).alias("precision"), share(tp, s).alias("recall"), share(2 * tp, s + p).alias("f1"))


def group_breakdown(confusion: DataFrame, dim: DataFrame) -> DataFrame:
    """Per host: support, correct (any class of the same host) and accuracy, ascending. dim: (class_id, host)."""
    t, p = dim.select(F.col("class_id").alias("target"), "host"), dim.select(F.col("class_id").alias("pred"), F.col("host").alias("pred_host"))
    rows = confusion.join(t, "target").join(p, "pred")
    out = rows.groupBy("host").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("host") == F.col("pred_host"), F.col("n")).otherwise(0)).alias("correct"))
    return out.withColumn("accuracy", F.round(F.col("correct") / F.col("support"), 6)).orderBy("accuracy", "host")


def confused_pairs(confusion: DataFrame, n: int = 10) -> DataFrame:
    return confusion.where("target <> pred").orderBy(F.desc("n"), "target", "pred").limit(n)


def worst_best(report: DataFrame, metric: str, n: int = 5) -> DataFrame:
    """(side, rank, class_id, metric): the n classes with support that are lowest and the n that are highest."""
    r = report.where("support > 0")
    out = None
    for side, order in (("worst", [F.asc(metric), F.asc("class_id")]), ("best", [F.desc(metric), F.asc("class_id")])):
        rows = r.orderBy(*order).limit(n).select(F.lit(side).alias("side"), "class_id", metric)
        out = rows if out is None else out.union(rows)
    return out


def smoothed_focal(logits: Column, target: Column, alpha: Column, gamma: float, smoothing: float, k: int) -> Column:
    """Focal loss of a row: 1 - smoothing on the target and smoothing / (k - 1) on the others, times alpha (1 - p) ** gamma."""
    lp = log_softmax(logits)
    at = F.element_at(lp, target + 1)
    total = F.aggregate(lp, F.lit(0.0), lambda a, x: a + x)
    ce = -(at * (1 - smoothing) + (total - at) * (smoothing / (k - 1)))
    return alpha * F.pow(1 - F.exp(at), F.lit(gamma)) * ce


def smoothed_ce(logits: Column, target: Column, smoothing: float, k: int) -> Column:
    """Cross entropy with smoothing / k on every class."""
    lp = log_softmax(logits)
    return -(F.element_at(lp, target + 1) * (1 - smoothing) + F.aggregate(lp, F.lit(0.0), lambda a, x: a + x) * (smoothing / k))


def focal_loss(scores: DataFrame, weights: DataFrame, k: int, gamma: float = 2.0, smoothing: float = 0.1) -> DataFrame:
    """Mean loss over all rows. weights: (class_id, weight), a dimension."""
    rows = scores.join(weights.select(F.col("class_id").alias("target"), "weight"), "target")
    return rows.agg(F.avg(smoothed_focal(F.col("logits"), F.col("target"), F.col("weight"), gamma, smoothing, k)).alias("loss"))


def multitask_loss(scores: DataFrame, weights: DataFrame, k: int, hosts: int, categories: int, gamma: float = 2.0, smoothing: float = 0.1) -> DataFrame:
    """Mean of the class loss + 0.2 host + 0.05 category cross entropy (smoothing 0.05)."""
    rows = scores.join(weights.select(F.col("class_id").alias("target"), "weight"), "target")
    main = smoothed_focal(F.col("logits"), F.col("target"), F.col("weight"), gamma, smoothing, k)
    host = smoothed_ce(F.col("host_logits"), F.col("host_target"), 0.05, hosts)
    category = smoothed_ce(F.col("category_logits"), F.col("category_target"), 0.05, categories)
    return rows.agg(F.avg(main + 0.2 * host + 0.05 * category).alias("loss"))

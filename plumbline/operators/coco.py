"""COCO detection metrics: average precision over IoU thresholds, by area and by label, and average recall.

Truth: (image_id, obj_id, label, xmin..ymax); detections: (image_id, det_id, label, score, xmin..ymax). A setting is an area range
with a threshold. What a detection is in each of the settings is kept as two bit masks (true positive; counted at all), so a
detection stays one row until precision is taken at the true positives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import box_area, box_iou
from plumbline.operators.lineage import checkpointed, stored

THRESHOLDS = [0.5 + 0.05 * i for i in range(10)]
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
#: Detections of an image and label that count.
MOST = 100
_BOX = ["xmin", "ymin", "xmax", "ymax"]
_T, _A = len(THRESHOLDS), len(AREAS)
_EVERY = (1 << _T) - 1


def _inside(area: Column, name: str) -> Column:
    return area.between(*AREAS[name])


def candidates(truth: DataFrame, detections: DataFrame, score_min: float) -> DataFrame:
    """(image_id, label, det_id, score, area, cands): the detections of images and labels with ground truth, the first MOST of an
    image and label by score, each with the ground truths (iou, obj_id, area) that it overlaps by the lowest threshold or more."""
    images, labels = truth.select("image_id").distinct(), truth.select("label").distinct()
    d = detections.where(F.col("score") >= score_min).join(images, "image_id", "left_semi").join(labels, "label", "left_semi")
    d = d.withColumn("r", F.row_number().over(W.partitionBy("image_id", "label").orderBy(F.desc("score"), "det_id"))).where(F.col("r") <= MOST)
    d = d.select("image_id", "label", "det_id", "score", box_area(*_BOX).alias("area"), *_BOX)
    g = truth.select("image_id", "label", F.col("obj_id").cast("long").alias("obj_id"), box_area(*_BOX).alias("g_area"), *(F.col(c).alias(f"g_{c}") for c in _BOX))
    iou = box_iou(_BOX, [f"g_{c}" for c in _BOX])
    pairs = d.join(g, ["image_id", "label"], "left").withColumn("iou", iou)
    cand = F.when(F.col("iou") >= THRESHOLDS[0], F.struct("iou", "obj_id", "g_area"))
    return pairs.groupBy("image_id", "label", "det_id", "score", "area").agg(F.collect_list(cand).alias("cands"))


def _alone(rows: DataFrame) -> DataFrame:
    """Masks of detections with at most one candidate, for which no other detection competes: plain arithmetic on columns."""
    best = F.get("cands", F.lit(0))
    passed = sum((F.coalesce(best["iou"] >= t, F.lit(False)).cast("int") for t in THRESHOLDS), F.lit(0))
    met = F.element_at(F.array(*(F.lit((1 << k) - 1) for k in range(_T + 1))), passed + 1)
    tp, counted = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i, a in enumerate(AREAS):
        hit = F.when(F.coalesce(_inside(best["g_area"], a), F.lit(False)), met).otherwise(0)
        free = F.when(_inside(F.col("area"), a), F.lit(_EVERY) - met).otherwise(0)
        tp = tp + hit.cast("long") * F.lit(1 << (_T * i))
        counted = counted + (hit + free).cast("long") * F.lit(1 << (_T * i))
    return rows.select("label", "score", "image_id", "det_id", tp.alias("tp"), counted.alias("counted"))


def _competing(groups: DataFrame) -> DataFrame:
    """Masks of detections that compete: groups (image_id, label, dets by falling score), one fold for each setting.

    A detection takes, of the free ground truths that it overlaps enough, one that counts in the area before one that doesn't,
    then the one with the largest overlap, then the later one. What takes one that doesn't count, or takes none and lies outside
    the area itself, is not counted.
    """
    limits = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in AREAS.values() for t in THRESHOLDS))

    def step(s: Column, d: Column, setting: Column) -> Column:
        free = F.filter(d["cands"], lambda x: (x["iou"] >= setting["t"]) & ~F.array_contains(s["used"], x["obj_id"]))
        best = F.array_max(F.transform(free, lambda x: F.struct(x["g_area"].between(setting["lo"], setting["hi"]).alias("inside"), x["iou"].alias("iou"), x["obj_id"].alias("obj_id"))))
        is_tp = F.coalesce(best["inside"], F.lit(False))
        counted = F.coalesce(best["inside"], d["area"].between(setting["lo"], setting["hi"]))
        used = F.when(best.isNull(), s["used"]).otherwise(F.concat(s["used"], F.array(best["obj_id"])))
        return F.struct(used.alias("used"), F.concat(s["out"], F.array(F.struct(is_tp.alias("tp"), counted.alias("counted")))).alias("out"))

    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<tp:boolean,counted:boolean>>").alias("out"))
    done = groups.withColumn("m", F.transform(limits, lambda setting: F.aggregate("dets", start, lambda s, d: step(s, d, setting))["out"]))
    each = done.select("image_id", "label", "m", F.posexplode("dets").alias("i", "d"))
    bits = F.array(*(F.lit(1 << c) for c in range(_T * _A)))
    mask = lambda what: F.aggregate(F.zip_with("m", bits, lambda row, b: F.when(F.get(row, F.col("i"))[what], b).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return each.select("label", (-F.col("d.minus")).alias("score"), "image_id", "d.det_id", mask("tp").alias("tp"), mask("counted").alias("counted"))


def matches(truth: DataFrame, detections: DataFrame, score_min: float = 0.05) -> DataFrame:
    """(label, score, image_id, det_id, tp, counted): a detection and its masks; bit area * 10 + threshold."""
    rows = candidates(truth, detections, score_min)
    # an image's and label's detections compete if one has two candidates or two have the same
    of = W.partitionBy("image_id", "label")
    objects = F.flatten(F.collect_list(F.transform("cands", lambda x: x["obj_id"])).over(of))
    competing = (F.max(F.size("cands")).over(of) > 1) | (F.size(F.array_distinct(objects)) < F.size(objects))
    rows = stored(rows.withColumn("competing", competing))  # read for both kinds
    det = F.struct((-F.col("score")).alias("minus"), "det_id", "area", "cands")
    groups = rows.where("competing").groupBy("image_id", "label").agg(F.array_sort(F.collect_list(det)).alias("dets"))
    return _alone(rows.where(~F.col("competing"))).unionByName(_competing(groups))


def _flags(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For a stretch of a label's detections in order: true positive and counted, [detection, setting]."""
    rows = rows.sort_values("place")
    tp, counted = ((rows[c].to_numpy()[:, None] >> np.arange(_T * _A)) & 1 for c in ("tp", "counted"))
    return tp.astype(bool), counted.astype(bool)


def _precision(tp: np.ndarray, counted: np.ndarray, base: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of true positives so far, and the precision at each true positive (elsewhere -1). base: a row a setting, in order."""
    k = np.cumsum(tp, axis=0) + base["k"].to_numpy()
    n = np.cumsum(counted, axis=0) + base["n"].to_numpy()
    return k, np.where(tp, k / np.maximum(n, 1), -1.0)


#: Detections of a stretch, about: ranges are cut by sampled quantiles.
STRETCH = 20_000


def precision_table(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(label, area, t, ap, recall) for labels with ground truth in the area; t is the threshold's place.

    By falling score, recall after the k-th true positive is k / truths. The precision at a recall point is the largest at or
    after the first rank that reaches it, so each true positive stands for the points p / 100 in ((k - 1) / truths, k / truths].
    A label's detections are ranked in stretches of bounded size: what lies before a stretch (sums) and after it (the largest
    precision) comes from a row a stretch and setting, so no task ranks a whole label.
    """
    own = truth.select("label", box_area(*_BOX).alias("area"), F.explode(F.array(*(F.struct(F.lit(a).alias("name"), F.lit(i).alias("i"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (a, (lo, hi)) in enumerate(AREAS.items())))).alias("a"))
    truths = own.where(F.col("area").between(F.col("a.lo"), F.col("a.hi"))).groupBy("label", F.col("a.name").alias("area"), F.col("a.i").alias("i")).agg(F.count("*").alias("truths"))
    grid = truths.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(_T - 1)))).withColumn("setting", F.col("i") * _T + F.col("t"))
    order = ["label", "minus", "image_id", "det_id"]
    found = stored(found.withColumn("minus", -F.col("score")).drop("score"))  # matched once: it is counted, sampled for ranges and dealt
    stretches = -(-found.count() // STRETCH) or 1  # a stated number, so that ranges are not put together again by their bytes
    placed = found.repartitionByRange(stretches, *order).sortWithinPartitions(*order)
    # a place in order instead of what is ordered by: no later pass reads or sorts ids
    ranked = stored(placed.select("label", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "tp", "counted"))
    stretch = ranked.groupBy("label", "part")
    label = f"label {found.schema['label'].dataType.simpleString()}"

    def totals(rows: pd.DataFrame) -> pd.DataFrame:
        tp, counted = _flags(rows)
        return pd.DataFrame({"label": rows.label.iloc[0], "part": rows.part.iloc[0], "setting": np.arange(_T * _A), "k": tp.sum(axis=0), "n": counted.sum(axis=0)})

    def tops(rows: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        _, p = _precision(*_flags(rows), base.sort_values("setting"))
        return base.assign(p=p.max(axis=0)[base.setting.to_numpy()])[["label", "part", "setting", "k", "n", "p"]]

    def points(rows: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        base = base.sort_values("setting")
        tp, counted = _flags(rows)
        k, p = _precision(tp, counted, base)
        envelope = np.maximum(np.maximum.accumulate(p[::-1], axis=0)[::-1], base["later"].to_numpy())
        every = base["truths"].to_numpy()
        held = np.maximum(every, 1)
        many = np.where(tp, (100 * k) // held - (100 * (k - 1)) // held + (k == 1), 0)
        out = pd.DataFrame({"label": base.label, "setting": base.setting, "ap": (envelope * many).sum(axis=0) / 101, "recall": np.where(tp, k / held, 0.0).max(axis=0)})
        return out[every > 0]

    sums = checkpointed(stretch.applyInPandas(totals, f"{label}, part int, setting int, k long, n long"))  # a row a stretch and setting
    before = W.partitionBy("label", "setting").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("label", "part", "setting", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("k", "n")))
    best = checkpointed(stretch.cogroup(base.groupBy("label", "part")).applyInPandas(tops, f"{label}, part int, setting int, k long, n long, p double"))
    after = W.partitionBy("label", "setting").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    last = best.withColumn("later", F.coalesce(F.max("p").over(after), F.lit(-1.0))).join(grid.select("label", "setting", "truths"), ["label", "setting"], "left").fillna(0, ["truths"])
    each = stretch.cogroup(last.groupBy("label", "part")).applyInPandas(points, f"{label}, setting int, ap double, recall double")
    done = each.groupBy("label", "setting").agg(F.sum("ap").alias("ap"), F.max("recall").alias("recall"))
    return grid.join(done, ["label", "setting"], "left").select("label", "area", "t", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("recall", F.lit(0.0)).alias("recall"))


def coco_map(truth: DataFrame, detections: DataFrame, score_min: float = 0.05) -> DataFrame:
    """(metric, value): map, ap50, ap75, small, medium, large and ar100 in percent, 4 decimals; -100 where nothing counts."""
    table = precision_table(truth, matches(truth, detections, score_min))
    mean = lambda cond, c="ap": F.coalesce(F.round(F.avg(F.when(F.expr(cond), F.col(c))) * 100, 4), F.lit(-100.0))
    row = table.agg(
        mean("area = 'all'").alias("map"), mean("area = 'all' and t = 0").alias("ap50"), mean("area = 'all' and t = 5").alias("ap75"),
        mean("area = 'small'").alias("small"), mean("area = 'medium'").alias("medium"), mean("area = 'large'").alias("large"), mean("area = 'all'", "recall").alias("ar100"),
    )
    return row.select(F.expr("stack(7, 'map', map, 'ap50', ap50, 'ap75', ap75, 'small', small, 'medium', medium, 'large', large, 'ar100', ar100) as (metric, value)"))


def per_class_ap(truth: DataFrame, detections: DataFrame, labels: DataFrame, score_min: float = 0.05) -> DataFrame:
    """(label, ap, ap50, ap75) in percent of every label of the dimension; -100 for labels without ground truth."""
    table = precision_table(truth, matches(truth, detections, score_min)).where("area = 'all'")
    mean = lambda cond: F.round(F.avg(F.when(F.expr(cond), F.col("ap"))) * 100, 4)
    rows = table.groupBy("label").agg(mean("true").alias("ap"), mean("t = 0").alias("ap50"), mean("t = 5").alias("ap75"))
    return labels.join(rows, "label", "left").fillna(-100.0, ["ap", "ap50", "ap75"])

"""Bounding boxes: cleaning, statistics, greedy matching, post-processing and sampling factors.

Boxes have image_id, obj_id, source_label (or label), width, height, xmin, ymin, xmax, ymax; detections have det_id and score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import box_area, box_filter_reasons
from plumbline.operators.lineage import checkpointed, dimension, stored
from plumbline.operators.selection import median

CORNERS = ("xmin", "ymin", "xmax", "ymax")


def with_reasons(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("filter_reasons", box_filter_reasons(*CORNERS, "width", "height")).withColumn("valid", F.size("filter_reasons") == 0)


def annotation_clean(boxes: DataFrame, label_map: DataFrame | None = None) -> DataFrame:
    """One row an image: raw objects in order with their reasons, the valid ones alone, counts, and the first error that applies.

    boxes may have a column ``doc``, the annotation document of a box: documents of an image with equal content count once
    (n_docs, n_duplicate_docs), and objects are numbered anew over those that stay. A box whose coordinates are all null is an
    object without a box. With a label map (source_label, detector_label, public_id) objects carry its labels. Errors:
    no_size, non_positive_size, incomplete_object (no label or no box), unmapped_label, inconsistent_size, no_valid_box.
    """
    b = boxes if "doc" in boxes.columns else boxes.withColumn("doc", F.lit(0))
    content = F.struct("obj_id", "source_label", "width", "height", *CORNERS)
    # one exchange, by image: every grouping and join below is by image and more, and finds its rows together
    docs = b.repartition("image_id").groupBy("image_id", "doc").agg(F.array_sort(F.collect_list(content)).alias("content"))
    kept = docs.groupBy("image_id", "content").agg(F.min("doc").alias("doc"), F.count("*").alias("times"))
    counts = kept.groupBy("image_id").agg(F.count("*").alias("n_docs"), F.sum(F.col("times") - 1).alias("n_duplicate_docs"))
    rows = kept.select("image_id", "doc", F.inline("content"))
    rows = with_reasons(rows).withColumn("incomplete", F.col("source_label").isNull() | (F.coalesce(*CORNERS).isNull()))
    names = ["detector_label", "public_id"] if label_map is not None else []
    if label_map is not None:
        rows = rows.join(dimension(label_map.select("source_label", *names)), "source_label", "left")
    unmapped = F.coalesce(F.bool_or(F.col("source_label").isNotNull() & F.col(names[0]).isNull()), F.lit(False)) if names else F.lit(False)
    raw = F.struct("doc", "obj_id", F.array(*CORNERS).alias("bbox"), "source_label", *names, "valid", "filter_reasons")
    out = rows.groupBy("image_id").agg(
        F.min("width").alias("width"), F.min("height").alias("height"),
        F.countDistinct("width", "height").alias("sizes"), F.bool_or(F.col("width").isNull() | F.col("height").isNull()).alias("no_size"),
        F.bool_or("incomplete").alias("incomplete"), unmapped.alias("unmapped"),
        F.array_sort(F.collect_list(raw)).alias("raw"),
    )
    pick = lambda o, i, cs: F.struct(i.cast("int").alias("obj_id"), *(o[c].alias(c) for c in cs))
    every = ["bbox", "source_label", *names]
    out = out.withColumn("raw_objects", F.transform("raw", lambda o, i: pick(o, i, [*every, "valid", "filter_reasons"])))
    out = out.withColumn("objects", F.transform(F.filter("raw_objects", lambda o: o["valid"]), lambda o: pick(o, o["obj_id"], every)))
    size_error = (F.col("width") <= 0) | (F.col("height") <= 0)
    error = F.when(F.col("no_size"), "no_size").when(size_error, "non_positive_size").when(F.col("incomplete"), "incomplete_object").when(F.col("unmapped"), "unmapped_label")
    error = error.when(F.col("sizes") > 1, "inconsistent_size").when(F.size("objects") == 0, "no_valid_box").otherwise("")
    return out.withColumn("error", error).join(counts, "image_id").drop("raw", "no_size", "incomplete", "unmapped")


def per_label_stats(boxes: DataFrame, label: str = "source_label") -> DataFrame:
    return boxes.groupBy(label).agg(F.countDistinct("image_id").alias("images"), F.count("*").alias("boxes"))


def label_space_audit(boxes: DataFrame, label_map: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """(subject, value, n, low, high): of each label space over valid boxes how many labels there are, the least and the largest (source,
    and with a label map also detector and public); raw, valid and filtered boxes and images; with images (image_format, image_mode)
    how many there are of each format and mode."""
    b = with_reasons(boxes)
    spaces = {"source": "source_label"}
    if label_map is not None:
        b = b.join(label_map.select("source_label", "detector_label", "public_id"), "source_label", "left")
        spaces |= {"detector": "detector_label", "public": "public_id"}
    good = lambda c: F.when(F.col("valid"), F.col(c))
    per = [x for s, c in spaces.items() for x in (F.countDistinct(good(c)).alias(f"n_{s}"), F.min(good(c)).cast("long").alias(f"low_{s}"), F.max(good(c)).cast("long").alias(f"high_{s}"))]
    row = b.agg(*per, F.count("*").alias("raw"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("filtered"), F.countDistinct("image_id").alias("images"))
    null = F.lit(None).cast("long")
    one = lambda kind, value, n, low=null, high=null: F.struct(F.lit(kind).alias("subject"), F.lit(value).alias("value"), n.alias("n"), low.alias("low"), high.alias("high"))
    rows = [one("labels", s, F.col(f"n_{s}"), F.col(f"low_{s}"), F.col(f"high_{s}")) for s in spaces] + [one("boxes", k, F.col(k)) for k in ("raw", "valid", "filtered")] + [one("images", "annotated", F.col("images"))]
    out = row.select(F.inline(F.array(*rows)))
    for kind in ("image_format", "image_mode") if images is not None else ():
        out = out.union(images.groupBy(F.lit(kind).alias("subject"), F.col(kind).alias("value")).agg(F.count("*").alias("n")).select("*", null.alias("low"), null.alias("high")))
    return out


def exceptions_report(boxes: DataFrame, test_images: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(kind, key, detail): duplicated documents (boxes with a column ``doc``) with how many are ignored, filtered boxes with their
    reasons, labels that the test images lack, and images (image_id) that no annotation names."""
    if "doc" in boxes.columns:
        clean = stored(annotation_clean(boxes).select("image_id", "width", "height", "n_duplicate_docs", "raw_objects"))  # read for each kind
        duplicated = clean.where("n_duplicate_docs > 0").select(F.lit("duplicated_document").alias("kind"), F.col("image_id").cast("string").alias("key"), F.col("n_duplicate_docs").cast("string").alias("detail"))
        again = clean.select("image_id", F.col("width"), F.col("height"), F.inline("raw_objects")).select("image_id", "width", "height", "obj_id", "source_label", *(F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(CORNERS)))
        return duplicated.union(exceptions_report(again, test_images, images))
    filtered = with_reasons(boxes).where(~F.col("valid")).select(F.lit("filtered_box").alias("kind"), F.concat_ws("/", "image_id", "obj_id").alias("key"), F.array_join("filter_reasons", ",").alias("detail"))
    gap = label_gap(boxes, test_images).select(F.lit("label_missing_in_test").alias("kind"), F.col("source_label").cast("string").alias("key"), F.lit("").alias("detail"))
    out = filtered.union(gap)
    if images is not None:
        extra = images.join(boxes.select("image_id").distinct(), "image_id", "left_anti").select(F.lit("extra_file").alias("kind"), F.col("image_id").cast("string").alias("key"), F.lit("").alias("detail"))
        out = out.union(extra)
    return out


def label_gap(boxes: DataFrame, test_images: DataFrame) -> DataFrame:
    """(source_label) of labels with a box in no test image."""
    labels = boxes.select("source_label").distinct()
    return labels.join(boxes.join(test_images, "image_id", "left_semi").select("source_label").distinct(), "source_label", "left_anti")


def dataset_geometry(boxes: DataFrame) -> DataFrame:
    """Images, objects an image, share of images with one object, and the median relative area, by counts in refined buckets."""
    b = checkpointed(boxes.select("image_id", (box_area(*CORNERS) / (F.col("width") * F.col("height"))).alias("area")))
    images = b.groupBy("image_id").agg(F.count("*").alias("k"))
    middle = F.lit(median(b, "area")).cast("double").alias("median_relative_area")
    return images.agg(F.count("*").alias("images"), F.avg("k").alias("objects_per_image"), F.avg((F.col("k") == 1).cast("double")).alias("single_object_share")).select("*", middle)


def object_index(boxes: DataFrame, order: list[str]) -> DataFrame:
    """The place of each object in its image, from 0."""
    return boxes.withColumn("obj_id", F.row_number().over(W.partitionBy("image_id").orderBy(*order)) - 1)


def repeat_factors(boxes: DataFrame, images: DataFrame, cap: float = 8.0, label: str = "source_label") -> DataFrame:
    """(image_id, factor): the largest min(cap, sqrt(most / n)) of the image's labels, n the label's boxes; 1 without boxes."""
    counts = boxes.groupBy(label).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    factors = counts.crossJoin(F.broadcast(most)).select(label, F.least(F.lit(cap), F.sqrt(F.col("most") / F.col("n"))).alias("f"))  # one row
    own = boxes.select("image_id", label).distinct().join(factors, label).groupBy("image_id").agg(F.max("f").alias("f"))
    return images.join(own, "image_id", "left").select("image_id", F.coalesce("f", F.lit(1.0)).alias("factor"))


def matched(truth: DataFrame, detections: DataFrame, iou_min: float = 0.5, score_min: float = 0.5) -> DataFrame:
    """Per image and label of the ground truth: n_truth, n_detections, tp.

    Detections by score (then det_id) each take the best unused ground truth with an IoU of at least iou_min, the first of
    equals. The join on image and label keeps pairs apart; IoUs are computed once a pair, and the fold over one image's and
    label's detections carries the used ground truths.
    """
    g = truth.groupBy("image_id", "label").agg(F.array_sort(F.collect_list(F.struct("obj_id", *CORNERS))).alias("g"))
    d = detections.where(F.col("score") >= score_min).groupBy("image_id", "label").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "det_id", *CORNERS))).alias("d"))
    area = lambda b: F.greatest(F.lit(0.0), b["xmax"] - b["xmin"]) * F.greatest(F.lit(0.0), b["ymax"] - b["ymin"])

    def iou(a: Column, b: Column) -> Column:
        inter = F.greatest(F.lit(0.0), F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])) * F.greatest(F.lit(0.0), F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"]))
        union = area(a) + area(b) - inter
        return F.when(union > 0, inter / union).otherwise(F.lit(0.0))

    both = g.join(d, ["image_id", "label"], "left").withColumn("d", F.coalesce("d", F.array()))
    both = both.select("image_id", "label", F.size("g").alias("n_truth"), F.size("d").alias("n_detections"), F.transform("d", lambda x: F.transform("g", lambda y: iou(x, y))).alias("ious"))

    def take(used: Column, row: Column) -> Column:
        free = F.transform(row, lambda v, k: F.when(F.array_contains(used, k) | (v < iou_min), F.lit(-1.0)).otherwise(v))
        best = F.array_max(free)
        return F.when(best >= iou_min, F.concat(used, F.array((F.array_position(free, best) - 1).cast("int")))).otherwise(used)

    used = F.aggregate("ious", F.array().cast("array<int>"), take)
    return both.select("image_id", "label", "n_truth", "n_detections", F.size(used).alias("tp"))


def precision_recall(matches: DataFrame) -> DataFrame:
    """tp, fp, fn, precision and recall over all matches. Detections of a label that their image has no ground truth of do not count."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    s = matches.agg(zero(F.sum("tp")).alias("tp"), zero(F.sum(F.col("n_detections") - F.col("tp"))).alias("fp"), zero(F.sum(F.col("n_truth") - F.col("tp"))).alias("fn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(F.lit(0.0))
    return s.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))


def postprocess(detections: DataFrame, score_min: float = 0.3, cap: int = 30) -> DataFrame:
    """Detections with a score of at least score_min, the first ``cap`` of each image by score, rounded for output."""
    ranked = detections.where(F.col("score") >= score_min).withColumn("rank", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("score"), "det_id")))
    rounded = [F.round(c, 2).alias(c) for c in CORNERS]
    return ranked.where(F.col("rank") <= cap).select("image_id", "det_id", "label", F.round("score", 6).alias("score"), *rounded, "rank")


def class_nms(detections: DataFrame, iou_max: float = 0.5, cap: int = 100) -> DataFrame:
    """(image_id, label, det_id) that survive: by score, a detection is dropped if it overlaps a survivor of its image and label
    by more than iou_max; at most ``cap`` an image."""
    box = F.struct((-F.col("score")).alias("minus"), "det_id", *CORNERS)
    lists = detections.groupBy("image_id", "label").agg(F.array_sort(F.collect_list(box)).alias("d"))
    area = lambda b: F.greatest(F.lit(0.0), b["xmax"] - b["xmin"]) * F.greatest(F.lit(0.0), b["ymax"] - b["ymin"])

    def over(a: Column, b: Column) -> Column:
        inter = F.greatest(F.lit(0.0), F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])) * F.greatest(F.lit(0.0), F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"]))
        return inter > F.lit(iou_max) * (area(a) + area(b) - inter)

    empty = F.slice(F.col("d"), 1, 0)
    kept = F.aggregate("d", empty, lambda s, x: F.when(F.exists(s, lambda y: over(y, x)), s).otherwise(F.concat(s, F.array(x))))
    rows = lists.select("image_id", "label", F.explode(kept).alias("k")).select("image_id", "label", "k.det_id", (-F.col("k.minus")).alias("score"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("score"), "det_id"))).where(F.col("rank") <= cap).drop("rank")

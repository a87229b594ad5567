"""The contract of a detection dataset, checked in one pass: every list, record and file of an image meets in one row.

Sources are put in one form (image_id, kind, ...), unioned and aggregated once by image_id; the row of an image then has an array of the
checks that it fails, and its counts go to an Observation of the same job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: The lists of a contract: the splits, and the official ones that they have to agree with.
LISTS = ("train", "val", "test", "official_trainval", "official_test")
_FILE = "struct<sha256:string,width:int,height:int>"


def official_partition(trainval: DataFrame, test: DataFrame) -> DataFrame:
    """(image_id, formal_index, official_partition, ordered) of two id lists (image_id, ord), one after the other.

    formal_index counts through both lists from 0 in their own order; ordered is false where an id does not follow, as text, the one before
    it in its list. Places come from the lists' ord: gaps in it are closed by counting how many places of the list are below, in two
    levels, so no list is one task's. An id in both lists has a row for each.
    """
    from plumbline.operators.prefix import running_total

    both = trainval.select("image_id", "ord", F.lit("trainval").alias("official_partition"), F.lit(0).alias("list")).union(test.select("image_id", "ord", F.lit("test"), F.lit(1)))
    both = both.withColumn("one", F.lit(1))
    placed = running_total(both, [], ["list", "ord", "image_id"], "one", "upto", stretch=F.format_string("%d-%012d", F.col("list"), F.floor(F.col("ord") / 4096)))
    before = placed.select((F.col("upto") + 1).alias("upto"), F.col("image_id").alias("last"), F.col("list").alias("same"))
    out = placed.join(before, "upto", "left")
    ordered = F.col("last").isNull() | (F.col("same") != F.col("list")) | (F.col("last").cast("string") < F.col("image_id").cast("string"))
    return out.select("image_id", (F.col("upto") - 1).alias("formal_index"), "official_partition", ordered.alias("ordered"))


def _safe(path: Column) -> Column:
    return path.isNotNull() & ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), F.lit(".."))


def detection_contract(lists: DataFrame, records: DataFrame, images: DataFrame, annotations: DataFrame, labels: tuple[int, int], public: tuple[int, int]) -> tuple[DataFrame, Observation]:
    """(check, image_id) of every check that an image fails, and an Observation of counts that is filled when the result is.

    lists: (list, image_id, ord), list one of LISTS. records: (image_id, image_path, annotation_path, width, height, image_sha256,
    annotation_sha256, n_raw, objects), objects array<struct<bbox array<double>, source_label, detector_label, public_id>>. images:
    (image_id, sha256, width, height) and annotations: (image_id, sha256), as found. labels, public: least and largest id of the two spaces.

    Checks, each once an image: split (not in exactly one of train, val and test), official (train and val, or test, differ from the official
    lists), test_order (another place in test than in the official test list), missing_record, repeated_record, unlisted_record (in no
    official list), unsafe_path, missing_image, missing_annotation, image_hash, annotation_hash, dimensions, invalid_box
    (not finite, empty, or outside the stated size), label_space. A null image_id is an image of its own.
    """
    none = lambda kind: F.lit(None).cast(kind)
    record = F.struct("image_path", "annotation_path", "width", "height", "image_sha256", "annotation_sha256", "n_raw", "objects")
    kind = records.select(record.alias("r")).schema["r"].dataType
    key = lists.schema["image_id"].dataType
    form = lambda df, source, ord_, r, f: df.select(F.col("image_id").cast(key).alias("image_id"), source.alias("source"), ord_.cast("long").alias("ord"), r.alias("r"), f.alias("f"))
    file = lambda *c: F.struct(*c).cast(_FILE)
    rows = (
        form(lists, F.col("list"), F.col("ord"), none(kind), none(_FILE))
        .union(form(records, F.lit("record"), none("long"), record, none(_FILE)))
        .union(form(images, F.lit("image"), none("long"), none(kind), file("sha256", "width", "height")))
        .union(form(annotations, F.lit("annotation"), none("long"), none(kind), file("sha256", none("int").alias("width"), none("int").alias("height"))))
    )
    times = lambda s: F.count_if(F.col("source") == s)
    at = lambda s: F.min(F.when(F.col("source") == s, F.col("ord")))
    found = lambda s, c: F.min(F.when(F.col("source") == s, F.col(c)))
    each = rows.groupBy("image_id").agg(
        *(times(s).alias(s) for s in LISTS), times("record").alias("records"), at("test").alias("test_at"), at("official_test").alias("official_at"),
        F.first("r", True).alias("r"), found("image", "f").alias("i"), found("annotation", "f").alias("a"),
    )
    box = lambda o: o["bbox"]
    finite = lambda o: F.forall(box(o), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    inside = lambda o: finite(o) & (box(o)[0] >= 0) & (box(o)[0] < box(o)[2]) & (box(o)[2] <= F.col("r.width")) & (box(o)[1] >= 0) & (box(o)[1] < box(o)[3]) & (box(o)[3] <= F.col("r.height"))
    spaced = lambda o: o["source_label"].isNotNull() & F.coalesce(o["detector_label"].between(*labels) & o["public_id"].between(*public), F.lit(False))
    official = F.col("official_trainval") + F.col("official_test")
    has, image, annotation = F.col("r").isNotNull(), F.col("i").isNotNull(), F.col("a").isNotNull()
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    checks = {
        "split": (F.col("train") + F.col("val") + F.col("test") != 1) & ((official > 0) | (F.col("train") + F.col("val") + F.col("test") > 0)),
        "official": (F.col("train") + F.col("val") > 0) != (F.col("official_trainval") > 0),
        "test_order": (F.col("test") > 0) & ~F.col("test_at").eqNullSafe(F.col("official_at")),
        "missing_record": (official > 0) & ~has,
        "repeated_record": F.col("records") > 1,
        "unlisted_record": has & (official == 0),
        "unsafe_path": has & ~(_safe(F.col("r.image_path")) & _safe(F.col("r.annotation_path"))),
        "missing_image": has & ~image,
        "missing_annotation": has & ~annotation,
        "image_hash": has & image & differs("r.image_sha256", "i.sha256"),
        "annotation_hash": has & annotation & differs("r.annotation_sha256", "a.sha256"),
        "dimensions": has & image & (differs("r.width", "i.width") | differs("r.height", "i.height")),
        "invalid_box": has & ~F.forall("r.objects", lambda o: F.coalesce(inside(o), F.lit(False))),
        "label_space": has & ~F.forall("r.objects", spaced),
    }
    failed = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), n) for n, c in checks.items())))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = Observation()
    judged = each.select("image_id", failed.alias("failed"), *LISTS, has.alias("has"), image.alias("image"), F.col("r.n_raw").alias("n_raw"), F.size("r.objects").alias("n_valid")).observe(
        counts, *(F.count_if(F.col(s) > 0).alias(s) for s in LISTS), F.count_if("has").alias("records"), F.count_if("image").alias("images"), total("n_raw").alias("raw_boxes"), total(F.when(F.col("has"), F.col("n_valid"))).alias("valid_boxes"), F.count_if(F.size("failed") > 0).alias("failed_images")
    )
    return judged.select(F.explode("failed").alias("check"), "image_id"), counts


def unexpected(counts: Observation, expected: dict[str, int]) -> dict[str, tuple[int, int]]:
    """name -> (expected, found) of the counts that are not as expected; the checked result has to have been written or read before."""
    found = counts.get
    return {k: (v, found.get(k)) for k, v in expected.items() if found.get(k) != v}

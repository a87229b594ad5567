"""Split of multi-label images: an exact share, with every label of two or more images on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.lineage import DIMENSION, checkpointed, stored
from plumbline.operators.selection import smallest

#: A label's images are counted by levels of their priorities, so many to an octave: the first few images of a label are told apart.
_STEPS, _RANGE = 16, 40
#: Images whose seeded number is within this many square roots of a label's images, as a share of them, of the ratio are left to the rounds.
#: A sample's count of a label is off by at most half a square root (standard deviation), so they are some 30 times what is to be moved.
BAND = 8.0
#: What part of a label's deviation a round takes from the images that stand for it.
SHARE = 0.6
#: How far a label may go beyond its share in a round: a part of its images and of their square root, and what is left of both a round later.
_SLACK, _ROOT, _LESS, _LESS_ROOT = 0.1, 0.4, 0.55, 0.7
#: What a label with nothing on one side weighs; all other labels weigh the square of their deviation by their images.
_BARE = 4.0
#: So many images of least harm are found by sorting, more by histograms.
_FEW = 10_000
#: The key of a row that stands for the image itself, so that the size of val is one more label's.
_ALL = ""


def _level(priority: Column) -> Column:
    return F.floor(_STEPS * F.log2(1 + priority * float(1 << _RANGE))).cast("int")


def _cut(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, cut): the highest level up to which at most ``most`` of the key's rows (*by, level, most) are; -1 if no level is."""
    counts = rows.groupBy(*by, "level").agg(F.count("*").alias("n"), F.max("most").alias("most"))
    upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy(*by).orderBy("level").rowsBetween(W.unboundedPreceding, 0)))  # levels, whatever the rows
    return upto.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("most"), F.col("level"))), F.lit(-1)).alias("cut"))


def image_labels(labels: DataFrame) -> DataFrame:
    """(image_id, labels): an image's distinct labels as an array, from rows of (image_id, label) without nulls, written to the shared folder."""
    pairs = labels.select("image_id", "label").where("image_id is not null and label is not null")
    return stored(pairs.groupBy("image_id").agg(F.sort_array(F.collect_set("label")).alias("labels")))


def multilabel_split(labels: DataFrame, ratio: float = 0.2, seed: int = 0, rounds: int = 12) -> DataFrame:
    """(image_id, side) with side "val" for exactly round-half-even(n * ratio) images, else "train". labels: (image_id, label). See split_images."""
    return split_images(image_labels(labels), ratio, seed, rounds).select("image_id", "side")


def split_images(images: DataFrame, ratio: float = 0.2, seed: int = 0, rounds: int = 12) -> DataFrame:
    """images (image_id, labels: distinct, without nulls), which are read several times, with ``side``: "val" for exactly round-half-even(n * ratio) of them, else "train".

    A label with n images wants about n * ratio of them in val, at least one if it has two, and never all. Every image has a seeded
    number, and is in val if that is below the ratio: so each label's count is off by about the square root of its images. Only images with
    a number near the ratio, by the images of their rarest label, are moved to mend that; those of rare labels all are, of frequent ones a
    share that falls as they grow. In a round an image is proposed to change sides if that lowers the sum of squared deviations by
    images, and stands for the label that gains most. SHARE of a label's deviation is taken from the images that stand for it, by levels
    of gain and priority, and of those the ones that take none of their labels too far, by levels again: never its last training
    image. The exact size is one more label, and is reached at last by the images that harm the others least, under the same guard;
    labels of one image never block it. Nothing is ranked or sorted, so neither the table nor a frequent label is one task's.

    All images are read to be counted by label, to find those near the ratio and to be returned, and are not exchanged for that unless
    a rare label makes the ratio's neighbourhood wide; a round is three jobs over the images near the ratio.
    """
    hashed = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}:{k}"), "image_id"), 11) / float(1 << 53)
    labelled = lambda df, *cols: df.select(*cols, F.explode(F.concat("labels", F.array(F.lit(None)))).alias("label"))  # noqa: E731  null for the image itself
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(_ALL))
    n = images.count()
    target = round(n * ratio)  # half-even
    if not target:
        return images.withColumn("side", F.lit("train"))
    drawn, val, real = hashed(0) < ratio, F.col("val"), F.col("key") != _ALL
    each = labelled(images, drawn.alias("drawn")).groupBy("label").agg(F.count("*").alias("s"), F.count_if("drawn").alias("drawn"))
    want = F.when(F.col("label").isNull(), target).otherwise(F.least(F.greatest(F.bround(F.col("s") * ratio), F.lit(1)), F.col("s") - 1))
    each = checkpointed(each.where("label is null or s >= 2").select(key.alias("key"), "s", want.cast("long").alias("want"), "drawn"))
    least, kinds = each.agg(F.min("s"), F.count("*")).first()
    dim = F.broadcast if kinds <= DIMENSION else lambda df: df
    off, near = hashed(0) - ratio, lambda s: BAND / F.sqrt(s)
    close = labelled(images.where(F.abs(off) <= near(F.lit(least))), "image_id").select("image_id", key.alias("key")).join(dim(each), "key")
    close = close.groupBy("image_id").agg(F.min("s").alias("s"), F.collect_list("key").alias("keys")).where((off >= -near("s")) & (off < near("s")))
    rows = stored(close.select("image_id", "keys", hashed(1).alias("p"), drawn.alias("drawn"), F.lit(False).alias("val")))

    def counted(rows: DataFrame, slack: Column) -> tuple[DataFrame, int, int]:
        """A row a label with what one more image in val or train gains and how many may come at most, how many labels are off by more than one image, and how many images are in val."""
        v, s, dev = F.col("v"), F.col("s"), F.col("dev")
        moved = rows.select(F.explode("keys").alias("key"), (val.cast("int") - F.col("drawn").cast("int")).alias("moved")).groupBy("key").agg(F.sum("moved").alias("moved"))
        t = moved.join(dim(each), "key").withColumn("v", F.col("drawn") + F.col("moved")).withColumn("dev", v - F.col("want"))
        bare = lambda c: F.when(real & c, _BARE).otherwise(0.0)
        off, have = t.agg(F.count_if(real & (F.abs("dev") > 1)), F.max(F.when(~real, v))).first()
        t = t.select(
            "key", "dev",
            (-(2 * dev + 1) / s + bare(v == 0)).alias("in_gain"), ((2 * dev - 1) / s + bare(v == s) - bare(v == 1)).alias("out_gain"),
            F.when(real, s - 1 - v).otherwise(n).alias("in_room"), F.when(real, v - 1).otherwise(n).alias("out_room"),
            F.greatest(F.lit(1), slack - dev).alias("in_most"), F.greatest(F.lit(1), slack + dev).alias("out_most"),
        )
        return t, off, have

    def gains(rows: DataFrame, t: DataFrame, size: bool) -> DataFrame:
        """Images with what it gains if they change sides, the label that gains most, whether a label of theirs lets none come, and how many each lets come."""
        way = lambda c: F.when(val, F.col(f"out_{c}")).otherwise(F.col(f"in_{c}"))
        part = way("gain") * (F.lit(1.0) if size else F.when(real, 1.0).otherwise(0.0))
        r = rows.select("image_id", F.explode("keys").alias("key"), "p", "drawn", "val").join(dim(t), "key")
        r = r.select("image_id", "p", "drawn", "val", F.struct(part.alias("part"), "key", "dev").alias("r"), F.struct("key", way("room").alias("room"), F.least(way("room"), way("most")).alias("most")).alias("guard"))
        # the parts are added as whole numbers, so that their order does not matter
        total = F.sum(F.round(F.col("r.part") * float(1 << _RANGE)).cast("long")) / float(1 << _RANGE)
        same = [F.first(c).alias(c) for c in ("p", "drawn", "val")]
        return r.groupBy("image_id").agg(*same, total.alias("gain"), F.max("r").alias("r"), F.bool_or(F.col("guard.room") <= 0).alias("stuck"), F.collect_list("guard").alias("guards"))

    def guarded(proposed: DataFrame, hard: bool) -> DataFrame:
        """The proposed images (image_id, val, level, guards) that take none of their labels beyond what may come, counting by levels all that are proposed."""
        r = proposed.select("image_id", "val", "level", F.explode("guards").alias("g")).select("image_id", "val", "level", "g.key", F.col("g.room" if hard else "g.most").alias("most"))
        return r.join(dim(_cut(r, ["key", "val"])), ["key", "val"]).groupBy("image_id").agg(F.bool_and(F.col("level") <= F.col("cut")).alias("flip")).where("flip")

    def flipped(rows: DataFrame, flips: DataFrame) -> DataFrame:
        """Written as files, since a checkpoint keeps Spark's estimate of its size, which joins multiply: a number with three times the digits each round."""
        d = rows.join(flips.select("image_id", "flip"), "image_id", "left")
        return stored(d.withColumn("val", val != F.coalesce("flip", F.lit(False))).drop("flip"))

    t, _, _ = counted(rows, F.lit(0))
    first = checkpointed(gains(rows, t, size=True).where("drawn").select("image_id", "val", _level(F.col("p")).alias("level"), "guards"))
    rows = flipped(rows, guarded(first, hard=True))
    for k in range(1, rounds):
        t, off, have = counted(rows, F.floor(F.greatest(_SLACK * _LESS**k * F.col("s"), _ROOT * _LESS_ROOT**k * F.sqrt("s"))))
        if not off and have == target:
            break
        g = gains(rows, t, size=True).where("gain > 0 and not stuck")
        level = _level(F.col("p") / F.pow(F.greatest(F.col("gain") * n, F.lit(1e-3)), F.lit(2)))
        wants = checkpointed(g.select("image_id", "val", level.alias("level"), F.col("r.key").alias("key"), F.greatest(F.lit(1), F.ceil(SHARE * F.abs("r.dev"))).alias("most"), "guards"))
        rows = flipped(rows, guarded(wants.join(dim(_cut(wants, ["key"])), "key").where("level <= cut"), hard=False))
    last = None
    while True:
        t, _, have = counted(rows, F.lit(0))
        room = target - have
        if not room:
            break
        g = gains(rows, t, size=False).where(~val & ~F.col("stuck") if room > 0 else val)
        able = checkpointed(g.select("image_id", "val", (-F.col("gain")).alias("harm"), "p", _level(F.col("p")).alias("level"), "guards"))
        least_harm = lambda k: able.orderBy("harm", "p").limit(k) if k <= _FEW else checkpointed(smallest(able, k, ["harm", "p"]))
        if have != last:
            new = guarded(least_harm(abs(room)), hard=True)
        else:  # the guard let none of them through
            new = least_harm(abs(room) if room < 0 else 1).withColumn("flip", F.lit(True))
            if new.isEmpty():
                raise ValueError(f"{room} more images are wanted, but each would take a label's last training image")
        rows, last = flipped(rows, new), have
    sides = rows.select("image_id", F.when(val, "val").otherwise("train").alias("moved"))
    return images.join(sides, "image_id", "left").select(*images.columns, F.coalesce("moved", F.when(drawn, "val").otherwise("train")).alias("side"))

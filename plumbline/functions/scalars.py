"""Column functions: names, paths, boxes, score arrays and progress. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_extension(name: Column | str) -> Column:
    """Lower-cased suffix of a path's last part with its dot, "<none>" where there is none (a leading dot is no suffix)."""
    last = F.regexp_extract(_c(name), r"([^/]*)$", 1)
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(last, r"[^.](\.[^.]+)$", 1)), F.lit("")), F.lit("<none>"))


def stable_tie_break(seed: int, key: Column | str) -> Column:
    """Hex sha256 of "seed:key": an order that is random, but the same in every run."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), _c(key).cast("string")), 256)


def relative_path(path: Column | str, root: str) -> Column:
    """path below root with forward slashes; a path outside root stays as it is."""
    posix, top = F.replace(_c(path), F.lit("\\"), F.lit("/")), root.rstrip("/") + "/"
    return F.when(F.startswith(posix, F.lit(top)), F.substring(posix, F.lit(len(top) + 1), F.length(posix))).otherwise(posix)


def is_safe_path(path: Column | str) -> Column:
    """Relative and without a ".." part."""
    return ~F.startswith(_c(path), F.lit("/")) & ~F.array_contains(F.split(_c(path), "/"), "..")


def error_text(kind: Column | str, message: Column | str, most: int = 400) -> Column:
    """"Type: message", cut to ``most`` characters."""
    return F.substring(F.concat_ws(": ", _c(kind), _c(message)), 1, most)


def normal_name(name: Column | str) -> Column:
    """A name without a bracketed end, lower case, with letters a-z and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(name)), r"\s*[(（][^()（）]*[)）]\s*$", ""), "[^a-z0-9]", "")


def box_filter_reasons(x1, y1, x2, y2, width, height) -> Column:
    """Why a box is invalid: "non_finite", or any of "non_positive_width", "non_positive_height", "out_of_bounds". Touching the border is valid."""
    x1, y1, x2, y2, width, height = map(_c, (x1, y1, x2, y2, width, height))
    inf = F.lit(float("inf"))
    odd = F.lit(False)
    for c in (x1, y1, x2, y2):
        odd = odd | F.coalesce(F.isnan(c) | (F.abs(c) == inf), F.lit(True))
    rest = F.array_compact(
        F.array(
            F.when(x2 <= x1, F.lit("non_positive_width")),
            F.when(y2 <= y1, F.lit("non_positive_height")),
            F.when((x1 < 0) | (y1 < 0) | (x2 > width) | (y2 > height), F.lit("out_of_bounds")),
        )
    )
    return F.when(odd, F.array(F.lit("non_finite"))).otherwise(rest)


def box_width(x1, x2) -> Column:
    return F.greatest(F.lit(0.0), _c(x2) - _c(x1))


def box_area(x1, y1, x2, y2) -> Column:
    return box_width(x1, x2) * box_width(y1, y2)


def box_iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of two (x1, y1, x2, y2); 0 where the union has no area."""
    ax1, ay1, ax2, ay2 = map(_c, a)
    bx1, by1, bx2, by2 = map(_c, b)
    inter = F.greatest(F.lit(0.0), F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(F.lit(0.0), F.least(ay2, by2) - F.greatest(ay1, by1))
    union = box_area(ax1, ay1, ax2, ay2) + box_area(bx1, by1, bx2, by2) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def box_hflip(x1, y1, x2, y2, width) -> Column:
    return F.struct((_c(width) - _c(x2)).alias("xmin"), _c(y1).alias("ymin"), (_c(width) - _c(x1)).alias("xmax"), _c(y2).alias("ymax"))


def box_clip(x1, y1, x2, y2, width, height) -> Column:
    cut = lambda v, most: F.least(F.greatest(_c(v).cast("double"), F.lit(0.0)), _c(most).cast("double"))
    return F.struct(cut(x1, width).alias("xmin"), cut(y1, height).alias("ymin"), cut(x2, width).alias("xmax"), cut(y2, height).alias("ymax"))


def softmax(scores: Column | str) -> Column:
    """Probabilities of an array of scores, shifted by the largest."""
    s = _c(scores)
    e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def log_softmax(scores: Column | str) -> Column:
    s = _c(scores)
    top = F.array_max(s)
    total = F.log(F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return F.transform(s, lambda x: x - top - total)


def top_k(scores: Column | str, k: int) -> Column:
    """Class ids (from 0) of the k largest scores, ties to the lower id."""
    pairs = F.transform(_c(scores), lambda x, i: F.struct((-x).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])


def argmax(scores: Column | str) -> Column:
    """Class id of the largest score, the lowest of equals."""
    return (F.array_position(_c(scores), F.array_max(_c(scores))) - 1).cast("int")


def clock(seconds: Column | str) -> Column:
    """HH:MM:SS of whole seconds."""
    s = F.floor(_c(seconds))
    two = lambda c: F.when(c < 100, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60))


def progress(done: Column | str, total: Column | str) -> Column:
    """Percent done within 0..100, 2 decimals; 0 where total is 0."""
    done, total = _c(done), _c(total)
    return F.when(total > 0, F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * done / total)), 2)).otherwise(F.lit(0.0))

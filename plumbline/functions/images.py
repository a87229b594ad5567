"""Format, size and mode of image files from their bytes, as column functions: headers are read, no pixel is decoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signatures and ends of files (hex), and the names of PNG's colour types and JPEG's numbers of components: fixed values of the formats.
PNG, PNG_END, JPEG, JPEG_END, GIF_END = "89504E470D0A1A0A", "0000000049454E44AE426082", "FFD8FF", "FFD9", "3B"
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
#: JPEG's frame headers: C0 to CF without C4, C8 and CC, which are tables and extensions.
JPEG_FRAMES = [x for x in range(0xC0, 0xD0) if x not in (0xC4, 0xC8, 0xCC)]
#: Segments of a JPEG that are walked to its frame header.
SEGMENTS = 64


def number(content: Column, at: int | Column, size: int, little: bool = False) -> Column:
    """The whole number in ``size`` bytes from place ``at`` (from 1); null if the content ends before."""
    at = F.lit(at) if isinstance(at, int) else at
    each = [F.hex(F.substring(content, at + k, F.lit(1))) for k in range(size)]
    text = F.concat(*(reversed(each) if little else each))
    return F.when(F.octet_length(content) >= at + (size - 1), F.conv(text, 16, 10).cast("long"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _begins(content: Column, text: str, at: int = 1) -> Column:
    return F.hex(F.substring(content, at, len(text) // 2)) == text


def _ends(content: Column, text: str) -> Column:
    return F.hex(F.substring(content, -(len(text) // 2), len(text) // 2)) == text


def _ascii(text: str) -> str:
    return text.encode().hex().upper()


def image_format(content: Column) -> Column:
    """PNG, JPEG, GIF or WEBP by the first bytes; null for anything else."""
    webp = _begins(content, _ascii("RIFF")) & _begins(content, _ascii("WEBP"), 9)
    return F.when(_begins(content, PNG), "PNG").when(_begins(content, JPEG), "JPEG").when(_begins(content, _ascii("GIF87a")) | _begins(content, _ascii("GIF89a")), "GIF").when(webp, "WEBP")


def _jpeg(content: Column) -> Column:
    """struct(width, height, parts) of the frame header, which is found by walking the segments; null if there is none."""
    start = F.struct(F.lit(3).cast("long").alias("at"), F.lit(False).alias("found"))

    def step(state: Column, _: Column) -> Column:
        marker, size = number(content, state["at"] + 1, 1), number(content, state["at"] + 2, 2)
        walks = (number(content, state["at"], 1) == 0xFF) & size.isNotNull() & (size >= 2)
        frame = F.coalesce(walks & marker.isin(JPEG_FRAMES), F.lit(False))
        there = F.when(frame, state["at"]).when(walks, state["at"] + 2 + size)
        return F.when(state["found"] | state["at"].isNull(), state).otherwise(F.struct(there.alias("at"), frame.alias("found")))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step)
    at = lambda e, k: F.when(e["found"], e["at"] + k)
    return _let(end, lambda e: F.struct(number(content, at(e, 7), 2).alias("width"), number(content, at(e, 5), 2).alias("height"), number(content, at(e, 9), 1).alias("parts")))


def _webp(content: Column) -> Column:
    """struct(width, height, alpha) of the lossy, lossless or extended kind."""
    kind, bits = F.hex(F.substring(content, 13, 4)), number(content, 22, 4, True)
    lossy, lossless, more = kind == _ascii("VP8 "), kind == _ascii("VP8L"), kind == _ascii("VP8X")
    low = lambda c, n: c.bitwiseAND(F.lit((1 << n) - 1))
    width = F.when(more, number(content, 25, 3, True) + 1).when(lossless, low(bits, 14) + 1).when(lossy, low(number(content, 27, 2, True), 14))
    height = F.when(more, number(content, 28, 3, True) + 1).when(lossless, low(F.shiftright(bits, 14), 14) + 1).when(lossy, low(number(content, 29, 2, True), 14))
    alpha = F.when(more, low(F.shiftright(number(content, 21, 1), 4), 1)).when(lossless, low(F.shiftright(bits, 28), 1)).otherwise(F.lit(0).cast("long"))
    return F.struct(width.alias("width"), height.alias("height"), alpha.alias("alpha"))


def image_header(content: str | Column) -> Column:
    """struct(image_format, image_mode, width, height, decode_error) of a file's bytes.

    decode_error is '' for an image whose header can be read and whose end is there; else Empty, UnknownFormat, BadHeader (no size can be
    read, or it is 0) or Truncated (the end is missing: PNG's and JPEG's last chunk or marker, GIF's trailer, WebP's stated length),
    each with what was found. Null content is Empty. Size and mode are null where the header has none; a truncated file may have them.
    """
    c = F.col(content) if isinstance(content, str) else content
    names = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in (kv[0], kv[1])))

    def parsed(x: Column) -> Column:
        kind, jpeg, webp = x["kind"], x["jpeg"], x["webp"]
        pick = lambda png, jpg, gif, web: F.when(kind == "PNG", png).when(kind == "JPEG", jpg).when(kind == "GIF", gif).when(kind == "WEBP", web)
        return F.struct(
            kind.alias("kind"),
            pick(names(PNG_MODES)[number(c, 26, 1).cast("int")], names(JPEG_MODES)[jpeg["parts"].cast("int")], F.lit("P"), F.when(webp["alpha"] == 1, "RGBA").otherwise("RGB")).alias("mode"),
            pick(number(c, 17, 4), jpeg["width"], number(c, 7, 2, True), webp["width"]).alias("width"),
            pick(number(c, 21, 4), jpeg["height"], number(c, 9, 2, True), webp["height"]).alias("height"),
            pick(_ends(c, PNG_END), _ends(c, JPEG_END), _ends(c, GIF_END), number(c, 5, 4, True) + 8 <= F.octet_length(c)).alias("whole"),
        )

    def judged(x: Column) -> Column:
        kind, sized = x["kind"], F.coalesce((x["width"] > 0) & (x["height"] > 0), F.lit(False))
        error = (
            F.when(F.coalesce(F.octet_length(c), F.lit(0)) == 0, "Empty: no bytes")
            .when(kind.isNull(), F.concat(F.lit("UnknownFormat: begins with "), F.lower(F.hex(F.substring(c, 1, 4)))))
            .when(~sized, F.concat(F.lit("BadHeader: "), kind, F.lit(" without a size")))
            .when(~F.coalesce(x["whole"], F.lit(False)), F.concat(F.lit("Truncated: "), kind, F.lit(" without its end")))
            .otherwise("")
        )
        return F.struct(kind.alias("image_format"), x["mode"].alias("image_mode"), x["width"].cast("int").alias("width"), x["height"].cast("int").alias("height"), error.alias("decode_error"))

    bound = _let(image_format(c), lambda kind: F.struct(kind.alias("kind"), F.when(kind == "JPEG", _jpeg(c)).alias("jpeg"), F.when(kind == "WEBP", _webp(c)).alias("webp")))
    return _let(_let(bound, parsed), judged)

"""Bitmap fonts as relations: 256 glyphs decoded from a metrics file by column functions, joined to the pixels of their
strip; texts laid out by running sums of advances over lines and glyphs, and drawn through their masks.

A font is two relations: glyphs (font_id, code, dx, dy, x0, y0, x1, y1, sx0, sy0, sx1, sy1, height, baseline) with pen
steps, boxes around the pen and boxes in the strip, and strokes (font_id, code, gx, gy, value), the strip's pixels by
glyph. Both are as large as the fonts, not the texts, and are joined by font and code.

Texts are Latin-1 and end at a NUL. Where glyph boxes overlap the later glyph's pixels count, blank ones too. A glyph whose
two boxes differ in size has an advance, but no pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.samples import quotient
from ..relation import KEYS, bands, grid, sizes, with_rows
from .geometry import transpose

GLYPHS = 256
#: The numbers of a glyph's record, signed 16 bits each, the high byte first.
RECORD = ("dx", "dy", "x0", "y0", "x1", "y1", "sx0", "sy0", "sx1", "sy1")
_TABLE = GLYPHS * 2 * len(RECORD)
_MAGIC = "PILfont\n"
#: What an empty line takes besides the spacing.
EMPTY_LINE = 10
SIDEWAYS = ("ROTATE_90", "ROTATE_270")
_ALIGN = {"left": 0.0, "center": 0.5, "right": 1.0}
_ACROSS, _DOWN = {"l": 0.0, "m": 0.5, "r": 1.0}, {"a": 0.0, "m": 0.5, "d": 1.0}


def _table(content: Column) -> Column:
    """The bytes of a metrics file after its DATA line, as a Latin-1 string; null if it has none."""
    text = F.decode(content, "ISO-8859-1")
    lines = F.concat(F.lit("\n"), F.regexp_replace(F.substring(text, F.lit(len(_MAGIC) + 1), F.length(text)), r"^[^\n]*\n?", ""))
    at = F.instr(lines, "\nDATA\n")
    return F.when(F.startswith(text, F.lit(_MAGIC)) & (at > 0), F.substring(lines, at + 6, F.lit(_TABLE)))


def font_errors(fonts: DataFrame) -> DataFrame:
    """(font_id, error) of the fonts (font_id, content) that have no readable metrics."""
    error = F.when(~F.startswith(F.decode("content", "ISO-8859-1"), F.lit(_MAGIC)), "Not a PILfont file").when(
        F.coalesce(F.length(_table(F.col("content"))), F.lit(0)) < _TABLE, "descriptor table has wrong size")
    return fonts.select("font_id", F.when(F.col("content").isNull(), "Not a PILfont file").otherwise(error).alias("error")).where("error is not null")


def font_info(fonts: DataFrame) -> DataFrame:
    """(font_id, info): the lines between the second one and DATA."""
    text = F.decode("content", "ISO-8859-1")
    lines = F.split(text, "\n", -1)
    stop = F.array_position(F.slice(lines, 3, F.size(lines)), "DATA")
    return fonts.where(F.startswith(text, F.lit(_MAGIC))).select("font_id", F.slice(lines, F.lit(3), F.greatest(stop - 1, F.lit(0)).cast("int")).alias("info"))


def font_glyphs(fonts: DataFrame, strips: DataFrame) -> DataFrame:
    """The glyphs of fonts (font_id, content); strips is the pixel relation of their images, named by font_id. Boxes that
    reach over the strip are cut, those around the pen along with them."""
    frame = sizes(strips).select(F.col("image_id").alias("font_id"), "w", "h")
    raw = fonts.withColumn("t", F.hex(F.encode(_table(F.col("content")), "ISO-8859-1"))).where(F.length("t") == 2 * _TABLE)
    rows = raw.select("font_id", "t", F.explode(F.sequence(F.lit(0), F.lit(GLYPHS - 1))).alias("code"))
    number = lambda k: F.conv(F.substring(F.col("t"), F.col("code") * (4 * len(RECORD)) + (4 * k + 1), F.lit(4)), 16, 10).cast("int")
    signed = lambda v: F.when(v >= 32768, v - 65536).otherwise(v)
    rows = rows.select("font_id", "code", *(signed(number(k)).alias(n) for k, n in enumerate(RECORD))).join(frame, "font_id")
    low = lambda n: F.greatest(-F.col(n), F.lit(0))
    over = lambda n, most: F.greatest(F.col(n) - F.col(most), F.lit(0))
    rows = rows.withColumns({
        "x0": F.col("x0") + low("sx0"), "y0": F.col("y0") + low("sy0"), "sx0": F.col("sx0") + low("sx0"), "sy0": F.col("sy0") + low("sy0"),
        "x1": F.col("x1") - over("sx1", "w"), "y1": F.col("y1") - over("sy1", "h"), "sx1": F.least("sx1", "w"), "sy1": F.least("sy1", "h")})
    whole = Window.partitionBy("font_id")
    top = F.least(F.min("y0").over(whole), F.lit(0))
    rows = rows.withColumns({"height": F.greatest(F.max("y1").over(whole), F.lit(0)) - top, "baseline": -top})
    return rows.select("font_id", "code", *RECORD, "height", "baseline")


def font_strokes(glyphs: DataFrame, strips: DataFrame) -> DataFrame:
    w, h = F.col("sx1") - F.col("sx0"), F.col("sy1") - F.col("sy0")
    sound = glyphs.where((w > 0) & (h > 0) & (w == F.col("x1") - F.col("x0")) & (h == F.col("y1") - F.col("y0")))
    places = sound.withColumn("y", F.explode(F.expr("sequence(sy0, sy1 - 1)"))).withColumn("x", F.explode(F.expr("sequence(sx0, sx1 - 1)")))
    pixels = strips.select(F.col("image_id").alias("font_id"), "x", "y", F.col("b0").alias("value"))
    return places.join(pixels, ["font_id", "x", "y"]).select(
        "font_id", "code", (F.col("x0") + F.col("x") - F.col("sx0")).alias("gx"), (F.col("y0") + F.col("y") - F.col("sy0")).alias("gy"), "value")


def lines_of(words: DataFrame, glyphs: DataFrame, spacing: int = 4, align: str = "left", anchor: str = "la", multiline: bool = True) -> DataFrame:
    """(image_id, font_id, line, text, width, height, left, top): the lines of words (image_id, font_id, text), placed around
    the point of their anchor."""
    if align not in _ALIGN or len(anchor) != 2 or anchor[0] not in _ACROSS or anchor[1] not in _DOWN:
        raise ValueError(f"no such alignment or anchor: {align}, {anchor}")
    split = F.split("text", "\n", -1) if multiline else F.array("text")
    lines = words.select("image_id", "font_id", F.posexplode(split).alias("line", "text")).withColumn("text", F.regexp_replace("text", "\\x00[\\s\\S]*", ""))
    steps = glyphs.select("font_id", "code", "dx")
    chars = lines.select("image_id", "font_id", "line", F.explode(F.split("text", "", -1)).alias("c")).where("c <> ''").withColumn("code", _code("c"))
    widths = chars.join(steps, ["font_id", "code"]).groupBy("image_id", "font_id", "line").agg(F.sum("dx").cast("int").alias("width"))
    heights = glyphs.groupBy("font_id").agg(F.any_value("height").alias("height"), F.any_value("baseline").alias("baseline"))
    rows = with_rows(lines, widths, ["image_id", "font_id", "line"], "left").join(heights, "font_id").withColumn("width", F.coalesce("width", F.lit(0)))
    empty = F.length("text") == 0
    text = Window.partitionBy("image_id", "font_id")
    before = text.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(empty, F.lit(EMPTY_LINE)).otherwise(F.col("height")) + spacing
    rows = rows.withColumns({"top": F.coalesce(F.sum(step).over(before), F.lit(0)).cast("int"), "widest": F.max("width").over(text)})
    bottom = F.max(F.when(~empty, F.col("top") + F.col("height")).otherwise(0)).over(text)
    share = lambda v, by: F.floor(v * by).cast("int")
    rows = rows.withColumn("depth", bottom).withColumns({
        "left": share(F.col("widest") - F.col("width"), _ALIGN[align]) - share(F.col("widest"), _ACROSS[anchor[0]]),
        "top": F.col("top") - share(F.col("depth"), _DOWN[anchor[1]])})
    return rows.select("image_id", "font_id", "line", "text", "width", "height", "baseline", "left", "top")


def _code(c: str) -> Column:
    """A character's Latin-1 code; others are an error."""
    code = F.ascii(c)
    return F.when(code < GLYPHS, code).otherwise(F.raise_error(F.concat(F.lit("not in Latin-1: "), F.col(c))).cast("int"))


def line_pixels(lines: DataFrame, glyphs: DataFrame, strokes: DataFrame) -> DataFrame:
    """(image_id, px, py, value): pixels of the lines, blank ones in glyph boxes too. A line's pixels stay within its width."""
    chars = lines.select("*", F.posexplode(F.split("text", "", -1)).alias("i", "c")).where("c <> ''").withColumn("code", _code("c"))
    chars = chars.join(glyphs.select("font_id", "code", "dx", "dy"), ["font_id", "code"])
    order = Window.partitionBy("image_id", "font_id", "line").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    pen = lambda n: F.coalesce(F.sum(n).over(order), F.lit(0)).cast("int")
    chars = chars.withColumns({"at": pen("dx"), "down": pen("dy") + F.col("baseline")})
    put = chars.join(strokes, ["font_id", "code"]).withColumns({"x": F.col("at") + F.col("gx"), "y": F.col("down") + F.col("gy")})
    put = put.where("x >= 0 and x < width and y >= 0 and y < height")
    last = F.max_by("value", F.struct("line", "i")).alias("value")
    return put.groupBy("image_id", (F.col("left") + F.col("x")).alias("px"), (F.col("top") + F.col("y")).alias("py")).agg(last)


def text_mask(words: DataFrame, glyphs: DataFrame, strokes: DataFrame, orientation: str | None = None) -> DataFrame:
    """The pixel relation of the masks of one-line words (image_id, font_id, text), turned; none for a text of no width."""
    lines = lines_of(words, glyphs, multiline=False)
    frames = lines.select("image_id", F.col("width").alias("w"), F.col("height").alias("h"))
    pixels = line_pixels(lines, glyphs, strokes).select("image_id", F.col("px").alias("x"), F.col("py").alias("y"), "value")
    mask = with_rows(grid(frames), pixels, ["image_id", "x", "y"], "left").select(*KEYS, F.coalesce("value", F.lit(0)).alias("b0"))
    return mask if orientation is None else transpose(mask, orientation)


def text_size(words: DataFrame, glyphs: DataFrame, orientation: str | None = None) -> DataFrame:
    """(image_id, left, upper, right, lower) of one-line words, turned."""
    lines = lines_of(words, glyphs, multiline=False)
    ends = ("height", "width") if orientation in SIDEWAYS else ("width", "height")
    return lines.select("image_id", F.lit(0).alias("left"), F.lit(0).alias("upper"), F.col(ends[0]).alias("right"), F.col(ends[1]).alias("lower"))


def text_advance(words: DataFrame, glyphs: DataFrame, orientation: str | None = None) -> DataFrame:
    """(image_id, length)."""
    if orientation in SIDEWAYS:
        raise ValueError("text that is turned by 90 or 270 degrees has no length")
    return lines_of(words, glyphs, multiline=False).select("image_id", F.col("width").alias("length"))


def multiline_box(words: DataFrame, glyphs: DataFrame, spacing: int = 4, align: str = "left", anchor: str = "la") -> DataFrame:
    """(image_id, left, upper, right, lower) around all lines that are not empty; no row for a text of empty lines."""
    lines = lines_of(words, glyphs, spacing, align, anchor).where("text <> ''")
    return lines.groupBy("image_id").agg(
        F.min("left").alias("left"), F.min("top").alias("upper"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("lower"))


def through_mask(df: DataFrame, pixels: DataFrame, at: tuple[int, int], fill: Sequence[int]) -> DataFrame:
    """df with the fill through the levels (image_id, px, py, value) from a place on."""
    level = pixels.select("image_id", (F.col("px") + at[0]).alias("x"), (F.col("py") + at[1]).alias("y"), F.col("value").alias("m"))
    joined = with_rows(df, level, ["image_id", "x", "y"], "left")
    mix = lambda b, v: F.when(F.coalesce("m", F.lit(0)) == 0, F.col(b)).otherwise(quotient(F.col("m") * v + F.col(b) * (255 - F.col("m")) + 127, 255))
    return joined.select(*KEYS, *(mix(b, v).alias(b) for b, v in zip(bands(df), fill, strict=True)))


def draw_text(df: DataFrame, at: tuple[int, int], words: DataFrame, glyphs: DataFrame, strokes: DataFrame, fill: Sequence[int], orientation: str | None = None) -> DataFrame:
    """One-line words on their images; masks are turned before they are placed."""
    if orientation is None:
        return through_mask(df, line_pixels(lines_of(words, glyphs, multiline=False), glyphs, strokes), at, fill)
    mask = text_mask(words, glyphs, strokes, orientation)
    return through_mask(df, mask.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("b0").alias("value")), at, fill)


def draw_multiline(df: DataFrame, at: tuple[int, int], words: DataFrame, glyphs: DataFrame, strokes: DataFrame, fill: Sequence[int],
                   spacing: int = 4, align: str = "left", anchor: str = "la") -> DataFrame:
    return through_mask(df, line_pixels(lines_of(words, glyphs, spacing, align, anchor), glyphs, strokes), at, fill)

"""The pixel relation: one row for each pixel of each image.

Columns: image_id, w, h (the image's size), x, y, and the bands b0, b1, ... of the mode. Samples are
ints (8-bit modes and I) or doubles (F). An image's size is on its rows, so images of any size share
a relation; nothing is partitioned by image unless an operator's keys ask for it, so one large image
is spread like many small ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("image_id", "w", "h", "x", "y")
#: Bands of each mode.
BANDS = {
    "1": 1, "L": 1, "P": 1, "I": 1, "F": 1, "I;16": 1, "LA": 2, "PA": 2, "La": 2,
    "RGB": 3, "YCbCr": 3, "HSV": 3, "LAB": 3, "RGBA": 4, "RGBa": 4, "RGBX": 4, "CMYK": 4,
}
#: Names of the bands, as getbands() gives them.
BAND_NAMES = {
    "1": ("1",), "L": ("L",), "P": ("P",), "I": ("I",), "F": ("F",), "I;16": ("I;16",), "LA": ("L", "A"), "PA": ("P", "A"),
    "La": ("L", "a"), "RGB": ("R", "G", "B"), "YCbCr": ("Y", "Cb", "Cr"), "HSV": ("H", "S", "V"), "LAB": ("L", "A", "B"),
    "RGBA": ("R", "G", "B", "A"), "RGBa": ("R", "G", "B", "a"), "RGBX": ("R", "G", "B", "X"), "CMYK": ("C", "M", "Y", "K"),
}


def bands(df: DataFrame) -> list[str]:
    return [c for c in ("b0", "b1", "b2", "b3") if c in df.columns]


def map_bands(df: DataFrame, fn: Callable[[Column], Column], only: Sequence[str] | None = None) -> DataFrame:
    """df with fn applied to its bands, or to those named."""
    return df.withColumns({b: fn(F.col(b)) for b in (bands(df) if only is None else only)})


def with_bands(df: DataFrame, *samples: Column) -> DataFrame:
    """df's places with other bands."""
    return df.select(*KEYS, *(s.alias(f"b{k}") for k, s in enumerate(samples)))


def moved(df: DataFrame, x: Column, y: Column, w: Column | None = None, h: Column | None = None) -> DataFrame:
    """df's samples at other places, in images of another size."""
    return df.select(
        "image_id", *((F.col(n) if c is None else c.cast("int")).alias(n) for n, c in (("w", w), ("h", h))),
        x.cast("int").alias("x"), y.cast("int").alias("y"), *bands(df))


def sizes(df: DataFrame) -> DataFrame:
    """(image_id, w, h), one row for each image."""
    return df.groupBy("image_id").agg(F.any_value("w").alias("w"), F.any_value("h").alias("h"))


def grid(frames: DataFrame) -> DataFrame:
    """Every place of each image of (image_id, w, h, ...)."""
    rows = frames.where("w > 0 and h > 0").withColumn("y", F.explode(F.expr("sequence(0, h - 1)")))
    return rows.withColumn("x", F.explode(F.expr("sequence(0, w - 1)")))


def same_places(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Pixels of a with those of b at the same place of the image with the same id; b's bands are c0, c1, ..."""
    other = b.select("image_id", "x", "y", *(F.col(x).alias(f"c{x[1:]}") for x in bands(b)))
    return with_rows(a, other, ["image_id", "x", "y"], how)


def with_rows(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """df joined with a relation of many rows an image, by merging. Spark takes exploded rows for no more bytes than what they
    are made of, and would broadcast them."""
    return df.join(other.hint("merge"), list(on), how)

"""Operators on two or more images: equality joins on image and place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.samples import clip, clip_round, muldiv255, quotient
from ..relation import KEYS, bands, same_places, sizes, with_rows


def _least_size(a: DataFrame, b: DataFrame, joined: DataFrame) -> DataFrame:
    other = sizes(b).select("image_id", F.col("w").alias("w2"), F.col("h").alias("h2"))
    joined = joined.join(other, "image_id")
    return joined.withColumns({"w": F.least("w", "w2"), "h": F.least("h", "h2")}).drop("w2", "h2")


def combine(a: DataFrame, b: DataFrame, fn: Callable[[Column, Column], Column], same_size: bool = True) -> DataFrame:
    """fn of the samples at the same place and band. Where sizes may differ the result has the least
    width and height. Operands of different modes are refused."""
    own = bands(a)
    if own != bands(b):
        raise ValueError("images do not have the same bands")
    joined = same_places(a, b)
    if not same_size:
        joined = _least_size(a, b, joined)
    return joined.select(*KEYS, *(fn(F.col(x), F.col(f"c{x[1:]}")).cast("int").alias(x) for x in own))


def add(a, b, scale: float = 1.0, offset: float = 0.0):
    return combine(a, b, lambda x, y: clip((x + y) / F.lit(float(scale)) + F.lit(float(offset))))


def subtract(a, b, scale: float = 1.0, offset: float = 0.0):
    return combine(a, b, lambda x, y: clip((x - y) / F.lit(float(scale)) + F.lit(float(offset))))


def multiply(a, b):
    return combine(a, b, lambda x, y: quotient(x * y, 255))


def screen(a, b):
    return combine(a, b, lambda x, y: 255 - quotient((255 - x) * (255 - y), 255))


def darker(a, b):
    return combine(a, b, F.least)


def lighter(a, b):
    return combine(a, b, F.greatest)


def difference(a, b):
    return combine(a, b, lambda x, y: F.abs(x - y))


def _hard(x: Column, y: Column) -> Column:
    """Multiplies where the second sample is dark, screens where it is light."""
    return F.when(y < 128, quotient(x * y, 127)).otherwise(255 - quotient((255 - y) * (255 - x), 127))


def overlay(a, b):
    return combine(a, b, lambda x, y: clip(_hard(y, x)))


def hard_light(a, b):
    return combine(a, b, lambda x, y: clip(_hard(x, y)))


def soft_light(a, b):
    def soft(x, y):
        dark = quotient((255 - x) * (x * y), 65536)
        return clip(dark + quotient(x * (255 - quotient((255 - x) * (255 - y), 255)), 255))

    return combine(a, b, soft)


def add_modulo(a, b):
    return combine(a, b, lambda x, y: F.pmod(x + y, F.lit(256)))


def subtract_modulo(a, b):
    return combine(a, b, lambda x, y: F.pmod(x - y, F.lit(256)))


def logical_and(a, b):
    return combine(a, b, lambda x, y: x.bitwiseAND(y))


def logical_or(a, b):
    return combine(a, b, lambda x, y: x.bitwiseOR(y))


def logical_xor(a, b):
    return combine(a, b, lambda x, y: x.bitwiseXOR(y))


def blend(a, b, alpha: float):
    """a * (1 - alpha) + b * alpha in all bands, cut; outside 0..1 it extrapolates and clips."""
    return combine(a, b, lambda x, y: clip(x + F.lit(float(alpha)) * (y - x)))


def composite(a: DataFrame, b: DataFrame, mask: DataFrame) -> DataFrame:
    """a where the mask is 255, b where it is 0, a rounded mix between; b where a or the mask has no pixel.
    The mask is L, or its last band counts."""
    own, level = bands(b), bands(mask)[-1]
    joined = with_rows(same_places(b, a, "left"), mask.select("image_id", "x", "y", F.col(level).alias("m")), ["image_id", "x", "y"], "left")
    mix = lambda x: quotient(F.col(f"c{x[1:]}") * F.col("m") + F.col(x) * (255 - F.col("m")) + 127, 255)
    return joined.select(*KEYS, *(F.coalesce(mix(x), F.col(x)).alias(x) for x in own))


def paste(dest: DataFrame, source: DataFrame, at: tuple[int, int], mask: DataFrame | None = None) -> DataFrame:
    """dest with the source's pixels from a corner on, clipped to dest; mask as in composite()."""
    shift = lambda df: df.withColumns({"x": F.col("x") + at[0], "y": F.col("y") + at[1]})
    if mask is not None:
        return composite(shift(source), dest, shift(mask))
    own = bands(dest)
    return same_places(dest, shift(source), "left").select(*KEYS, *(F.coalesce(f"c{x[1:]}", x).alias(x) for x in own))


def paste_color(dest: DataFrame, colour: tuple[int, ...], box: tuple[int, int, int, int], mask: DataFrame | None = None) -> DataFrame:
    """dest with a colour in a half-open box."""
    x, y = F.col("x"), F.col("y")
    inside = (x >= box[0]) & (x < box[2]) & (y >= box[1]) & (y < box[3])
    own = bands(dest)
    if mask is None:
        return dest.withColumns({b: F.when(inside, v).otherwise(F.col(b)) for b, v in zip(own, colour, strict=True)})
    level = mask.select("image_id", (F.col("x") + box[0]).alias("x"), (F.col("y") + box[1]).alias("y"), F.col("b0").alias("m"))
    joined = with_rows(dest, level, ["image_id", "x", "y"], "left")
    mix = lambda b, v: F.when(inside & F.col("m").isNotNull(), quotient(F.col("m") * v + F.col(b) * (255 - F.col("m")) + 127, 255)).otherwise(F.col(b))
    return joined.select(*KEYS, *(mix(b, v).alias(b) for b, v in zip(own, colour, strict=True)))


def alpha_composite(dest: DataFrame, source: DataFrame) -> DataFrame:
    """RGBA source over dest (Porter and Duff), in doubles, rounded. Nothing over nothing stays dest."""
    joined = same_places(dest, source)
    da, sa = F.col("b3") / 255.0, F.col("c3") / 255.0
    out = sa + da * (1.0 - sa)
    mix = lambda k: clip_round((F.col(f"c{k}") * sa + F.col(f"b{k}") * da * (1.0 - sa)) / out)
    samples = [*(mix(k) for k in range(3)), clip_round(out * 255.0)]
    return joined.select(*KEYS, *(F.when(out > 0, v).otherwise(F.col(f"b{k}")).alias(f"b{k}") for k, v in enumerate(samples)))


def premultiplied(df: DataFrame) -> DataFrame:
    """RGBA to RGBa."""
    return df.withColumns({b: muldiv255(F.col(b), F.col("b3")) for b in ("b0", "b1", "b2")})

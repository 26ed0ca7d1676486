"""Geometry without new samples: coordinates are projected, and gaps filled from a grid of places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.samples import clip, muldiv255
from ..relation import KEYS, bands, grid, moved, sizes


def _c(name: str) -> Column:
    return F.col(name)


def _with_margins(shifted: DataFrame, frames: DataFrame, fill: Sequence[int]) -> DataFrame:
    """shifted and, without a join, the places of the frames (image_id, w, h, ow, oh, left, top) outside the image
    of size ow, oh whose corner is at left, top."""
    x, y = _c("x") - _c("left"), _c("y") - _c("top")
    margin = grid(frames).where((x < 0) | (y < 0) | (x >= _c("ow")) | (y >= _c("oh")))
    filled = (F.lit(v).cast(shifted.schema[b].dataType).alias(b) for b, v in zip(bands(shifted), fill, strict=True))
    return shifted.unionByName(margin.select(*KEYS, *filled))


def _canvas(df: DataFrame, w: Column, h: Column, left: int, top: int) -> DataFrame:
    """Frames of another size, with the old size and its corner's place beside it."""
    kept = (_c("w").alias("ow"), _c("h").alias("oh"), F.lit(left).alias("left"), F.lit(top).alias("top"))
    return sizes(df).select("image_id", w.cast("int").alias("w"), h.cast("int").alias("h"), *kept)


def crop(df: DataFrame, box: Sequence[float]) -> DataFrame:
    """A half-open box, rounded to whole pixels; what lies outside the image is zero."""
    left, top, right, bottom = (int(round(v)) for v in box)
    if right < left or bottom < top:
        raise ValueError("the box ends before it begins")
    w, h = right - left, bottom - top
    x, y = _c("x"), _c("y")
    inside = df.where((x >= left) & (x < right) & (y >= top) & (y < bottom))
    shifted = moved(inside, x - left, y - top, F.lit(w), F.lit(h))
    outside = _canvas(df, F.lit(w), F.lit(h), -left, -top).where(F.lit(left < 0 or top < 0) | (F.lit(right) > _c("ow")) | (F.lit(bottom) > _c("oh")))
    return _with_margins(shifted, outside, [0] * len(bands(df)))


#: method -> (x, y, w, h) after it.
TRANSPOSES = {
    "FLIP_LEFT_RIGHT": lambda x, y, w, h: (w - 1 - x, y, w, h),
    "FLIP_TOP_BOTTOM": lambda x, y, w, h: (x, h - 1 - y, w, h),
    "ROTATE_90": lambda x, y, w, h: (y, w - 1 - x, h, w),
    "ROTATE_180": lambda x, y, w, h: (w - 1 - x, h - 1 - y, w, h),
    "ROTATE_270": lambda x, y, w, h: (h - 1 - y, x, h, w),
    "TRANSPOSE": lambda x, y, w, h: (y, x, h, w),
    "TRANSVERSE": lambda x, y, w, h: (h - 1 - y, w - 1 - x, h, w),
}


def transpose(df: DataFrame, method: str) -> DataFrame:
    return moved(df, *TRANSPOSES[method](_c("x"), _c("y"), _c("w"), _c("h")))


def flip(df: DataFrame) -> DataFrame:
    return transpose(df, "FLIP_TOP_BOTTOM")


def mirror(df: DataFrame) -> DataFrame:
    return transpose(df, "FLIP_LEFT_RIGHT")


#: EXIF orientation -> the transpose that sets it right.
ORIENTATIONS = {2: "FLIP_LEFT_RIGHT", 3: "ROTATE_180", 4: "FLIP_TOP_BOTTOM", 5: "TRANSPOSE", 6: "ROTATE_270", 7: "TRANSVERSE", 8: "ROTATE_90"}


def exif_transpose(df: DataFrame, orientations: DataFrame) -> DataFrame:
    """Each image by its orientation (image_id, orientation); others stay. One projection of cases."""
    joined = df.join(orientations.select("image_id", "orientation"), "image_id", "left")
    args = [_c(n) for n in ("x", "y", "w", "h")]
    out = list(args)
    for value, method in ORIENTATIONS.items():
        for k, to in enumerate(TRANSPOSES[method](*args)):
            out[k] = F.when(_c("orientation") == value, to).otherwise(out[k])
    return moved(joined, *out)


def offset(df: DataFrame, dx: int, dy: int) -> DataFrame:
    """A shift that wraps around."""
    return moved(df, F.pmod(_c("x") + dx, _c("w")), F.pmod(_c("y") + dy, _c("h")))


def expand(df: DataFrame, border: int, fill: Sequence[int]) -> DataFrame:
    frames = _canvas(df, _c("w") + 2 * border, _c("h") + 2 * border, border, border)
    shifted = moved(df, _c("x") + border, _c("y") + border, _c("w") + 2 * border, _c("h") + 2 * border)
    return _with_margins(shifted, frames, fill)


def crop_border(df: DataFrame, border: int) -> DataFrame:
    x, y, w, h = _c("x"), _c("y"), _c("w"), _c("h")
    inside = df.where((x >= border) & (y >= border) & (x < w - border) & (y < h - border))
    return moved(inside, x - border, y - border, w - 2 * border, h - 2 * border)


def premultiplied(df: DataFrame) -> DataFrame:
    """Samples weighted by alpha, the last band."""
    last = bands(df)[-1]
    return df.withColumns({b: muldiv255(F.col(b), F.col(last)) for b in bands(df)[:-1]})


def unmultiplied(df: DataFrame) -> DataFrame:
    """Samples without the weight of alpha, the last band."""
    a = F.col(bands(df)[-1])
    back = lambda v: F.when((a == 0) | (a == 255), v).otherwise(clip(F.floor(v * 255 / F.greatest(a, F.lit(1)))))
    return df.withColumns({b: back(F.col(b)) for b in bands(df)[:-1]})


def reduce(df: DataFrame, fx: int, fy: int | None = None, box: Sequence[int] | None = None, alpha: bool = False) -> DataFrame:
    """The mean of each block, in 24-bit fixed point; blocks at the far edges have their own count. A box is cut out
    first. ``alpha``: the last band is alpha, samples are weighted by it."""
    df = crop(df, box) if box is not None else df
    if alpha:
        return unmultiplied(reduce(premultiplied(df), fx, fy))
    fy = fx if fy is None else fy
    down = lambda c, f: F.floor(c / f).cast("int")
    own = bands(df)
    keys = [down(_c("x"), fx).alias("x"), down(_c("y"), fy).alias("y")]
    sums = df.groupBy("image_id", *keys).agg(
        F.any_value("w").alias("w"), F.any_value("h").alias("h"), F.count(F.lit(1)).alias("n"), *(F.sum(b).alias(b) for b in own))
    # 2**24 / n, rounded down, is the multiplier of a sum.
    mean = lambda b: F.shiftright((_c(b) + F.floor(_c("n") / 2)) * F.floor(F.lit(1 << 24) / _c("n")), 24).cast("int")
    ceil = lambda c, f: F.ceil(_c(c) / f).cast("int").alias(c)
    return sums.select("image_id", ceil("w", fx), ceil("h", fy), "x", "y", *(mean(b).alias(b) for b in own))


def pad_to(df: DataFrame, w: int, h: int, left: Column, top: Column, fill: Sequence[int]) -> DataFrame:
    """Images on a canvas of another size, their corner at a place that an image's w and h give."""
    left, top = left.cast("int"), top.cast("int")
    x, y = _c("x") + left, _c("y") + top
    on = df.where((x >= 0) & (y >= 0) & (x < w) & (y < h))
    frames = sizes(df).select("image_id", F.lit(w).alias("w"), F.lit(h).alias("h"), _c("w").alias("ow"), _c("h").alias("oh"), left.alias("left"), top.alias("top"))
    return _with_margins(moved(on, x, y, F.lit(w), F.lit(h)), frames, fill)

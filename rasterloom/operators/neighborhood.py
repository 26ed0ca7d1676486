"""Neighbourhood operators: windows over rows, then over columns.

A row's pixels are gathered by a window over (image, y), the gathered rows by one over (image, x). So a
pixel crosses the network twice whatever the kernel's size, and a large image is spread over as many
tasks as it has rows or columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.samples import clip, quotient
from ..relation import KEYS, bands, map_bands

#: Name -> (kernel, scale, offset), the first row for the pixels below.
KERNELS = {
    "CONTOUR": ((-1, -1, -1, -1, 8, -1, -1, -1, -1), 1, 255),
    "DETAIL": ((0, -1, 0, -1, 10, -1, 0, -1, 0), 6, 0),
    "EDGE_ENHANCE": ((-1, -1, -1, -1, 10, -1, -1, -1, -1), 2, 0),
    "EDGE_ENHANCE_MORE": ((-1, -1, -1, -1, 9, -1, -1, -1, -1), 1, 0),
    "EMBOSS": ((-1, 0, 0, 0, 1, 0, 0, 0, 0), 1, 128),
    "FIND_EDGES": ((-1, -1, -1, -1, 8, -1, -1, -1, -1), 1, 0),
    "SHARPEN": ((-2, -2, -2, -2, 32, -2, -2, -2, -2), 16, 0),
    "SMOOTH": ((1, 1, 1, 1, 5, 1, 1, 1, 1), 13, 0),
    "BLUR": ((1, 1, 1, 1, 1, 1, 0, 0, 0, 1, 1, 0, 0, 0, 1, 1, 0, 0, 0, 1, 1, 1, 1, 1, 1), 16, 0),
    "SMOOTH_MORE": ((1, 1, 1, 1, 1, 1, 5, 5, 5, 1, 1, 5, 44, 5, 1, 1, 5, 5, 5, 1, 1, 1, 1, 1, 1), 100, 0),
}


def _along(axis: str):
    other = {"x": "y", "y": "x"}[axis]
    return Window.partitionBy("image_id", other).orderBy(axis)


def _at(value: Column, shift: int, axis: str) -> Column:
    return F.lag(value, -shift).over(_along(axis)) if shift else value


def gathered(df: DataFrame, radius: int) -> DataFrame:
    """df with n0, n1, ...: for each band its square neighbourhood, an array of rows from y - radius on.
    Rows outside the image are null, and so are places outside it in a row."""
    own, steps = bands(df), range(-radius, radius + 1)
    rows = df.select(*KEYS, *own, *(F.array(*(_at(F.col(b), k, "x") for k in steps)).alias(f"r{b[1:]}") for b in own))
    return rows.select(*KEYS, *own, *(F.array(*(_at(F.col(f"r{b[1:]}"), k, "y") for k in steps)).alias(f"n{b[1:]}") for b in own))


def _weighted(df: DataFrame, kernel: Sequence[float], scale: float | None, offset: float, top: int | None) -> dict[str, Column]:
    """Each band's filtered value, over the rows of gathered()."""
    size = {9: 3, 25: 5}.get(len(kernel))
    if size is None:
        raise ValueError("bad kernel size")
    scale = sum(kernel) if scale is None else scale
    scale = max(float(scale), 1e-4) if scale >= 0 else float(scale)
    radius, out = size // 2, {}
    inside = F.col("x").between(radius, F.col("w") - 1 - radius) & F.col("y").between(radius, F.col("h") - 1 - radius)
    for b in bands(df):
        n = F.col(f"n{b[1:]}")
        terms = [n[2 * radius - j][i] * F.lit(kernel[j * size + i]) for j in range(size) for i in range(size) if kernel[j * size + i]]
        total = sum(terms[1:], terms[0]) / F.lit(scale) + F.lit(offset + 0.5)
        value = clip(total) if top == 255 else F.greatest(F.lit(0), F.floor(total)).cast("int")
        out[b] = F.when(inside, value).otherwise(F.col(b))
    return out


def kernel_filter(df: DataFrame, kernel: Sequence[float], scale: float | None = None, offset: float = 0, top: int | None = 255) -> DataFrame:
    """A 3 by 3 or 5 by 5 kernel; the border that it does not fit in stays. ``top`` None is for mode I,
    which has no upper bound."""
    out = _weighted(df, kernel, scale, offset, top)
    return gathered(df, {9: 1, 25: 2}[len(kernel)]).select(*KEYS, *(v.alias(b) for b, v in out.items()))


def named_filter(df: DataFrame, name: str) -> DataFrame:
    return kernel_filter(df, *KERNELS[name])


def sharpness(df: DataFrame, factor: float) -> DataFrame:
    """From the smoothed image (factor 0) to the image (1) and beyond."""
    smooth = _weighted(df, *KERNELS["SMOOTH"], 255)
    mix = lambda b: clip(smooth[b] * F.lit(1.0 - factor) + F.col(b) * F.lit(float(factor)))
    return gathered(df, 1).select(*KEYS, *(mix(b).alias(b) for b in bands(df)))


def _box(df: DataFrame, radius: float, axis: str) -> DataFrame:
    """One pass of the extended box along an axis, in 24-bit fixed point, edges repeated."""
    r, size = int(radius), F.col({"x": "w", "y": "h"}[axis])
    whole = int(np.float32(1 << 24) / np.float32(np.float32(radius) * np.float32(2) + np.float32(1)))
    part = ((1 << 24) - (2 * r + 1) * whole) // 2
    along, at = _along(axis), F.col(axis)
    every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def value(v: Column) -> Column:
        first, last = F.first(v).over(every), F.last(v).over(every)
        total = F.sum(v).over(along.rowsBetween(-r, r))
        total = total + first * F.greatest(F.lit(0), F.lit(r) - at) + last * F.greatest(F.lit(0), at + r - size + 1)
        ends = F.coalesce(F.lag(v, r + 1).over(along), first) + F.coalesce(F.lead(v, r + 1).over(along), last)
        return F.shiftright(total * whole + ends.cast("bigint") * part + (1 << 23), 24).cast("int")

    return map_bands(df, value)


def box_blur(df: DataFrame, radius: int, passes: int = 1) -> DataFrame:
    """Whole radii only."""
    if radius != int(radius) or radius < 0:
        raise ValueError("the radius is a whole number")
    return _blurred(df, radius, passes) if radius else df


def _blurred(df: DataFrame, radius: float, passes: int) -> DataFrame:
    for axis in ("x", "y"):
        for _ in range(passes):
            df = _box(df, radius, axis)
    return df


def gaussian_radius(sigma: float, passes: int = 3) -> float:
    """The box radius whose repeated blur has the deviation sigma."""
    share = sigma * sigma / passes
    low = math.floor((math.sqrt(12.0 * share + 1.0) - 1.0) / 2.0)
    return low + (2 * low + 1) * (low * (low + 1) - 3.0 * share) / (6.0 * (share - (low + 1) ** 2))


def gaussian_blur(df: DataFrame, sigma: float) -> DataFrame:
    """Three extended box blurs an axis."""
    return _blurred(df, float(np.float32(gaussian_radius(sigma))), 3) if sigma > 0 else df


def unsharp_mask(df: DataFrame, radius: float = 2, percent: int = 150, threshold: int = 3) -> DataFrame:
    """Samples moved from their blurred value, where they differ from it by more than the threshold. The samples
    ride along with their blurred ones."""
    blurred = gaussian_blur(df.withColumns({f"s{b[1:]}": F.col(b) for b in bands(df)}), radius)

    def value(b: str) -> Column:
        own = F.col(f"s{b[1:]}")
        gap = own - F.col(b)
        return F.when(F.abs(gap) > threshold, clip(own + quotient(gap * percent, 100))).otherwise(own)

    return blurred.select(*KEYS, *(value(b).alias(b) for b in bands(df)))


def _odd(size: int) -> int:
    return 1 if size == 1 else max(3, size) | 1


def _clamped(df: DataFrame, radius: int) -> DataFrame:
    """gathered(), with places outside the image taken from its nearest edge."""
    own, steps = bands(df), range(-radius, radius + 1)
    near = lambda v, k, axis: F.coalesce(*(_at(v, s, axis) for s in range(k, 0, -1 if k > 0 else 1)), v)
    rows = df.select(*KEYS, *own, *(F.array(*(near(F.col(b), k, "x") for k in steps)).alias(f"r{b[1:]}") for b in own))
    return rows.select(*KEYS, *own, *(F.array(*(near(F.col(f"r{b[1:]}"), k, "y") for k in steps)).alias(f"n{b[1:]}") for b in own))


def rank_filter(df: DataFrame, size: int, rank: int) -> DataFrame:
    """The sample of the rank (0 the least) in the square around each pixel."""
    size = _odd(size)
    if not 0 <= rank < size * size:
        raise ValueError("bad rank value")
    own = bands(df)
    pick = lambda b: F.element_at(F.array_sort(F.flatten(F.col(f"n{b[1:]}"))), rank + 1)
    return _clamped(df, size // 2).select(*KEYS, *(pick(b).alias(b) for b in own))


def median_filter(df: DataFrame, size: int = 3) -> DataFrame:
    return rank_filter(df, size, _odd(size) ** 2 // 2)


def _extreme(df: DataFrame, size: int, fn) -> DataFrame:
    r = _odd(size) // 2
    for axis in ("x", "y"):
        df = map_bands(df, lambda v, axis=axis: fn(v).over(_along(axis).rowsBetween(-r, r)))
    return df


def min_filter(df: DataFrame, size: int = 3) -> DataFrame:
    return _extreme(df, size, F.min)


def max_filter(df: DataFrame, size: int = 3) -> DataFrame:
    return _extreme(df, size, F.max)


def mode_filter(df: DataFrame, size: int = 3) -> DataFrame:
    """The most frequent sample around each pixel, the least of equals, if it occurs more than twice."""
    own = bands(df)

    def value(b: str) -> Column:
        around = F.filter(F.flatten(F.filter(F.col(f"n{b[1:]}"), lambda r: r.isNotNull())), lambda v: v.isNotNull())
        counted = F.transform(F.array_distinct(around), lambda v: F.struct(F.size(F.filter(around, lambda o: o == v)).alias("n"), (-v).alias("m")))
        best = F.array_max(counted)
        return F.when(best["n"] > 2, -best["m"]).otherwise(F.col(b))

    return gathered(df, _odd(size) // 2).select(*KEYS, *(value(b).alias(b) for b in own))

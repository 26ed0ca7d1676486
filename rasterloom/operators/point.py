"""Point operators: each sample or pixel on its own. All are projections."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.samples import clip, lookup, luma
from ..relation import bands, map_bands, with_bands


def table_of(fn: Callable[[int], float]) -> list[int]:
    """fn at 0..255, cut to 0..255: evaluated once, on the driver."""
    return [max(0, min(255, int(fn(v)))) for v in range(256)]


def point(df: DataFrame, table: Sequence[int]) -> DataFrame:
    """Samples through a table of 256 entries, or of 256 for each band."""
    own = bands(df)
    if len(table) not in (256, 256 * len(own)):
        raise ValueError("wrong number of lut entries")
    each = len(table) > 256
    return df.withColumns({b: lookup(list(table[256 * k * each :][:256]), F.col(b)) for k, b in enumerate(own)})


def evaluate(df: DataFrame, fn: Callable[[int], float]) -> DataFrame:
    return point(df, table_of(fn))


def invert(df: DataFrame) -> DataFrame:
    return map_bands(df, lambda v: 255 - v)


def posterize(df: DataFrame, bits: int) -> DataFrame:
    bits = max(1, min(8, bits))
    return map_bands(df, lambda v: v.bitwiseAND(F.lit(256 - (1 << (8 - bits)))))


def solarize(df: DataFrame, threshold: int = 128) -> DataFrame:
    return map_bands(df, lambda v: F.when(v >= threshold, 255 - v).otherwise(v))


def grayscale(df: DataFrame) -> DataFrame:
    """RGB to L."""
    return with_bands(df, luma(*map(F.col, ("b0", "b1", "b2"))))


def colorize_tables(black, white, mid=None, blackpoint: int = 0, whitepoint: int = 255, midpoint: int = 127) -> list[list[int]]:
    """For each channel the value of each grey level: straight lines between the colours, rounded down."""
    if not 0 <= blackpoint <= (midpoint if mid else whitepoint) <= whitepoint <= 255:
        raise ValueError("points are not in order")
    stops = [(blackpoint, black), (midpoint, mid), (whitepoint, white)] if mid else [(blackpoint, black), (whitepoint, white)]
    tables = []
    for channel in range(3):
        own = [(at, colour[channel]) for at, colour in stops]
        table = []
        for level in range(256):
            after = next((k for k, (at, _) in enumerate(own) if level < at), len(own))
            if after in (0, len(own)):
                table.append(own[0 if after == 0 else -1][1])
            else:
                (a, low), (b, high) = own[after - 1], own[after]
                table.append(low + (level - a) * (high - low) // (b - a))
        tables.append(table)
    return tables


def colorize(df: DataFrame, black, white, mid=None, blackpoint: int = 0, whitepoint: int = 255, midpoint: int = 127) -> DataFrame:
    """L to RGB."""
    tables = colorize_tables(black, white, mid, blackpoint, whitepoint, midpoint)
    return with_bands(df, *(lookup(t, F.col("b0")) for t in tables))


def brightness(df: DataFrame, factor: float, alpha: bool = False) -> DataFrame:
    """Samples times the factor; an alpha band stays."""
    own = bands(df)
    return map_bands(df, lambda v: clip(v * F.lit(float(factor))), own[:-1] if alpha else own)


def mixed(low, v, factor: float):
    """low * (1 - factor) + v * factor, cut to 0..255."""
    return clip(low * F.lit(1.0 - factor) + v * F.lit(float(factor)))


def saturation(df: DataFrame, factor: float) -> DataFrame:
    """RGB towards or away from its grey; further bands stay."""
    grey = luma(*map(F.col, ("b0", "b1", "b2")))
    return map_bands(df, lambda v: mixed(grey, v, factor), ["b0", "b1", "b2"])


def contrast(df: DataFrame, factor: float, mode: str | None = None) -> DataFrame:
    """L, RGB or CMYK (to be named) towards or away from the image's mean grey, rounded. One aggregate, joined back. The
    grey of CMYK is black ink alone."""
    from .color import convert

    own = bands(df)
    cmyk = mode == "CMYK"
    grey = F.col("b0") if len(own) < 3 or cmyk else luma(*map(F.col, own[:3]))
    source = convert(df, "CMYK", "L") if cmyk else df
    means = source.groupBy("image_id").agg(F.floor(F.sum(grey) / F.count(F.lit(1)) + 0.5).cast("int").alias("mean"))
    joined = df.join(means, "image_id")
    if cmyk:
        low = [F.lit(0), F.lit(0), F.lit(0), 255 - F.col("mean")]
        return joined.withColumns({b: mixed(v, F.col(b), factor) for b, v in zip(own, low, strict=True)}).select(df.columns)
    return map_bands(joined, lambda v: mixed(F.col("mean"), v, factor), own[: 1 if len(own) < 3 else 3]).select(df.columns)


def color_lut_3d(df: DataFrame, size: tuple[int, int, int], table: Sequence[float]) -> DataFrame:
    """RGB through a 3-D table of RGB triples in 0..1, first axis fastest, trilinear in fixed point:
    entries with 6 bits beyond 8-bit samples, places with 18 bits, interpolation with 15."""
    n0, n1, n2 = size
    if len(table) != 3 * n0 * n1 * n2:
        raise ValueError("the table does not fit its size")
    entries = [round(v * 255 * 64) for v in table]
    lut = F.array(*map(F.lit, entries))
    places = []
    for band, n in zip(("b0", "b1", "b2"), size, strict=True):
        at = F.col(band).cast("bigint") * F.lit(round((n - 1) / 255 * (1 << 18)))
        cell = F.least(F.shiftright(at, 18), F.lit(max(0, n - 2)))
        places.append((cell.cast("int"), F.shiftright(at - F.shiftleft(cell, 18), 3).cast("int")))
    (i, fi), (j, fj), (k, fk) = places
    step = [1 if n > 1 else 0 for n in size]

    def corner(di: int, dj: int, dk: int, channel: int):
        at = (i + di * step[0]) + (j + dj * step[1]) * n0 + (k + dk * step[2]) * (n0 * n1)
        return F.element_at(lut, at * 3 + (channel + 1))

    between = lambda a, b, f: F.shiftright(a * (32768 - f) + b * f, 15)
    out = []
    for channel in range(3):
        planes = []
        for dk in (0, 1):
            lines = [between(corner(0, dj, dk, channel), corner(1, dj, dk, channel), fi) for dj in (0, 1)]
            planes.append(between(*lines, fj))
        out.append(clip(F.shiftright(between(*planes, fk) + 32, 6)))
    return df.withColumns(dict(zip(("b0", "b1", "b2"), out, strict=True)))


def lut_table(size: tuple[int, int, int], fn: Callable[[float, float, float], tuple[float, float, float]]) -> list[float]:
    """A table for color_lut_3d from a function of r, g, b in 0..1."""
    axis = lambda n: [v / max(1, n - 1) for v in range(n)]
    return [v for b in axis(size[2]) for g in axis(size[1]) for r in axis(size[0]) for v in fn(r, g, b)]


def lut_transformed(size: tuple[int, int, int], table: Sequence[float], fn: Callable[..., Sequence[float]], with_normals: bool = False) -> list[float]:
    """A table whose entries are fn of the old ones, with r, g, b of the entry's place before them if asked for."""
    places = zip(*[iter(lut_table(size, lambda r, g, b: (r, g, b)))] * 3, strict=True)
    entries = zip(*[iter(table)] * 3, strict=True)
    return [v for place, entry in zip(places, entries, strict=True) for v in (fn(*place, *entry) if with_normals else fn(*entry))]

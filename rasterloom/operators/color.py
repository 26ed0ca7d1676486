"""Colour conversion, palettes and quantisation to a palette."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import samples as S
from ..relation import BANDS, with_bands, with_rows


def _bands(n: int) -> list[Column]:
    return [F.col(f"b{k}") for k in range(n)]


def _to_rgb(mode: str) -> list[Column]:
    """RGB of a pixel of the mode."""
    b = _bands(BANDS[mode])
    if mode in ("RGB", "RGBA", "RGBX"):
        return b[:3]
    if mode in ("L", "1", "LA"):
        return [b[0]] * 3
    if mode in ("I", "F"):
        return [S.clip(b[0])] * 3
    if mode == "CMYK":
        return list(S.cmyk_to_rgb(*b))
    if mode == "YCbCr":
        return list(S.ycbcr_to_rgb(*b))
    if mode == "HSV":
        return list(S.hsv_to_rgb(*b))
    raise ValueError(f"no conversion from {mode}")


def _luma(mode: str) -> Column:
    b = _bands(BANDS[mode])
    if mode in ("L", "LA", "1"):
        return b[0]
    if mode in ("I", "F"):
        return S.clip(b[0])
    if mode == "YCbCr":
        return b[0]
    return S.luma(*_to_rgb(mode))


def convert(df: DataFrame, source: str, target: str) -> DataFrame:
    """A projection for each pair of modes. Palettes have functions of their own."""
    if source == target:
        return df
    full, b = F.lit(255), _bands(BANDS.get(source, 0))
    alpha = b[-1] if source in ("LA", "RGBA", "PA") else full
    if target == "1":
        cut = b[0] if source in ("L", "LA") else S.luma_cut(*_to_rgb(source))
        return with_bands(df, F.when(cut >= 128, 255).otherwise(0))
    if target in ("L", "LA"):
        return with_bands(df, _luma(source), *([alpha] if target == "LA" else []))
    if target == "I":
        whole = F.greatest(F.lit(-2147483648.0), F.least(F.lit(2147483647.0), b[0])).cast("int") if source == "F" else _luma(source)
        return with_bands(df, whole)
    if target == "F":
        if source in ("L", "1", "I", "LA"):
            return with_bands(df, b[0].cast("float").cast("double"))
        r, g, bl = _to_rgb(source)
        return with_bands(df, ((r * 299 + g * 587 + bl * 114) / F.lit(1000.0)).cast("float").cast("double"))
    if target == "RGB":
        return with_bands(df, *_to_rgb(source))
    if target in ("RGBA", "RGBX"):
        return with_bands(df, *_to_rgb(source), alpha if target == "RGBA" else full)
    if target == "CMYK":
        if source in ("L", "LA", "1", "I", "F"):
            return with_bands(df, F.lit(0), F.lit(0), F.lit(0), 255 - _luma(source))
        return with_bands(df, *(255 - v for v in _to_rgb(source)), F.lit(0))
    if target == "YCbCr":
        if source in ("L", "LA", "1"):
            return with_bands(df, b[0], F.lit(128), F.lit(128))
        return with_bands(df, *S.rgb_to_ycbcr(*_to_rgb(source)))
    if target == "HSV":
        return with_bands(df, *S.rgb_to_hsv(*_to_rgb(source)))
    raise ValueError(f"no conversion from {source} to {target}")


def convert_matrix(df: DataFrame, matrix: Sequence[float]) -> DataFrame:
    """RGB by 4 numbers to L, by 12 to RGB: weights and an offset for each band, rounded."""
    if len(matrix) not in (4, 12):
        raise ValueError("a matrix has 4 or 12 numbers")
    r, g, b = _bands(3)
    rows = [matrix[k : k + 4] for k in range(0, len(matrix), 4)]
    return with_bands(df, *(S.clip_round(r * F.lit(float(m[0])) + g * F.lit(float(m[1])) + b * F.lit(float(m[2])) + F.lit(float(m[3]))) for m in rows))


def expand_palette(df: DataFrame, palette: DataFrame, alpha: bool = False) -> DataFrame:
    """P or PA to RGB(A) by a palette (image_id, idx, r, g, b, a). An index without an entry is black,
    and opaque; PA keeps its own alpha. The join is on image and index, so a palette may be any size."""
    entries = palette.select("image_id", F.col("idx").alias("b0"), "r", "g", "b", "a")
    joined = with_rows(df, entries, ["image_id", "b0"], "left")
    rgb = [F.coalesce(c, F.lit(0)) for c in ("r", "g", "b")]
    own = F.col("b1") if "b1" in df.columns else F.coalesce("a", F.lit(255))
    return with_bands(joined, *rgb, *([own] if alpha else []))


def remap_palette(df: DataFrame, dest_map: Sequence[int]) -> DataFrame:
    """Indices to their place in dest_map, the first of several; others to 0."""
    places: dict[int, int] = {}
    for new, old in enumerate(dest_map):
        places.setdefault(old, new)
    return df.withColumn("b0", S.lookup([places.get(v, 0) for v in range(256)], F.col("b0")))


def nearest_palette(df: DataFrame, palette: Sequence[tuple[int, int, int]]) -> DataFrame:
    """RGB to the index of the nearest of at most 256 colours, the first of equals."""
    r, g, b = _bands(3)
    best = F.array_min(F.array(*(
        F.struct(((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)).alias("d"), F.lit(k).alias("k"))
        for k, (pr, pg, pb) in enumerate(palette))))
    return with_bands(df, best["k"])


def web_palette() -> list[tuple[int, int, int]]:
    """226 colours: ten times black, then the levels 0, 51, ..., 255 of each band, red fastest."""
    levels = range(0, 256, 51)
    return [(0, 0, 0)] * 10 + [(r, g, b) for b in levels for g in levels for r in levels]


def to_web_palette(df: DataFrame) -> DataFrame:
    """RGB to the index of its nearest colour of the web palette, the first of equals. Colours are looked up in
    steps of four, so a band's level is that nearest to the step below it."""
    level = lambda b: F.floor((2 * (b - b % 4) + 51) / 102).cast("int")
    r, g, b = map(level, _bands(3))
    index = r + 6 * g + 36 * b
    return with_bands(df, F.when(index == 0, 0).otherwise(index + 10))


def put_palette(frames: DataFrame, colours: Sequence[tuple[int, ...]]) -> DataFrame:
    """Palette rows (image_id, idx, r, g, b, a) for each image of frames."""
    entries = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("idx", "r", "g", "b", "a"), (k, *c, *([255] * (4 - len(c)))), strict=True))) for k, c in enumerate(colours)))
    return frames.select("image_id", F.explode(entries).alias("p")).select("image_id", "p.*")


def apply_transparency(palette: DataFrame, transparency: int | Sequence[int]) -> DataFrame:
    """Palette rows with alpha from an image's transparency: an index that is clear, or alphas of the first indices."""
    if isinstance(transparency, int):
        alpha = F.when(F.col("idx") == transparency, 0).otherwise(F.col("a"))
    else:
        known = F.array(*map(F.lit, transparency)) if transparency else F.array().cast("array<int>")
        alpha = F.coalesce(F.try_element_at(known, F.col("idx") + 1), F.col("a"))
    return palette.withColumn("a", alpha.cast("int"))


def get_palette(palette: DataFrame, rawmode: str = "RGB") -> DataFrame:
    """(image_id, palette): the entries' bytes in the raw mode's order, as one array."""
    order = {"RGB": ("r", "g", "b"), "RGBA": ("r", "g", "b", "a"), "BGR": ("b", "g", "r"), "RGBX": ("r", "g", "b", "a")}[rawmode]
    rows = palette.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("idx", "r", "g", "b", "a"))).alias("p"))
    return rows.select("image_id", F.flatten(F.transform("p", lambda e: F.array(*(e[c] for c in order)))).alias("palette"))


def palette_color(palette: DataFrame, colour: tuple[int, int, int]) -> DataFrame:
    """(image_id, idx): the first index of the colour, or the next free one."""
    r, g, b = colour
    same = F.min(F.when((F.col("r") == r) & (F.col("g") == g) & (F.col("b") == b), F.col("idx")))
    return palette.groupBy("image_id").agg(F.coalesce(same, F.max("idx") + 1).cast("int").alias("idx"))


def put_alpha(df: DataFrame, alpha: int | DataFrame) -> DataFrame:
    """L or RGB with an alpha band, LA or RGBA with another; alpha is a level or an L relation."""
    own = [c for c in ("b0", "b1", "b2") if c in df.columns]
    own = own[:1] if len([c for c in df.columns if c in ("b0", "b1", "b2", "b3")]) < 3 else own
    if isinstance(alpha, int):
        return with_bands(df, *map(F.col, own), F.lit(alpha))
    mask = alpha.select("image_id", "x", "y", F.col("b0").alias("m"))
    return with_bands(with_rows(df, mask, ["image_id", "x", "y"]), *map(F.col, own), F.col("m"))


def split(df: DataFrame) -> DataFrame:
    """(image_id, w, h, x, y, band, b0): bands as rows."""
    own = [c for c in ("b0", "b1", "b2", "b3") if c in df.columns]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("band"), F.col(b).alias("v")) for k, b in enumerate(own))))
    return df.withColumn("s", rows).select("image_id", "w", "h", "x", "y", "s.band", F.col("s.v").alias("b0"))


def get_channel(df: DataFrame, band: int) -> DataFrame:
    return with_bands(df, F.col(f"b{band}"))


def merge(*channels: DataFrame) -> DataFrame:
    """L relations with the same places to one of as many bands."""
    first = channels[0].select("image_id", "w", "h", "x", "y", "b0")
    for k, c in enumerate(channels[1:], 1):
        first = with_rows(first, c.select("image_id", "x", "y", F.col("b0").alias(f"b{k}")), ["image_id", "x", "y"])
    return with_bands(first, *(F.col(f"b{k}") for k in range(len(channels))))


def palette_text(palette: DataFrame, mode: str = "RGB") -> DataFrame:
    """(image_id, text): 256 lines of an index and its colour's components, missing entries black."""
    line = F.struct(F.col("idx").cast("int").alias("k"), F.concat_ws(" ", "idx", "r", "g", "b").alias("t"))
    rows = palette.groupBy("image_id").agg(F.collect_list(F.when(F.col("idx").between(0, 255), line)).alias("p"))
    twice = F.size(F.array_distinct("p.k")) < F.size("p")
    rows = rows.withColumn("p", F.when(twice, F.raise_error(F.lit("an index of a palette has two entries"))).otherwise(F.col("p")))
    black = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(255)), F.col("p.k")), lambda k: F.struct(k.alias("k"), F.concat(k.cast("string"), F.lit(" 0 0 0")).alias("t")))
    body = F.array_join(F.array_sort(F.concat("p", black))["t"], "\n")
    return rows.select("image_id", F.concat(F.lit(f"# Palette\n# Mode: {mode}\n"), body, F.lit("\n")).alias("text"))

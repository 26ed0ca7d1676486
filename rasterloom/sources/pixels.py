"""Pixel relations from formulas, arrays and bytes, and back to arrays and bytes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..relation import BANDS, KEYS, bands, grid


def new(spark: SparkSession, size: tuple[int, int], colour: Sequence[int], image_id: int = 0) -> DataFrame:
    """One image of one colour."""
    return constant(spark.range(1).select(F.lit(image_id).cast("bigint").alias("image_id")), size, colour)


def constant(images: DataFrame, size: tuple[int, int], colour: Sequence[int]) -> DataFrame:
    """An image of one colour for each row (image_id)."""
    frames = images.select("image_id", F.lit(size[0]).alias("w"), F.lit(size[1]).alias("h"))
    return grid(frames).select(*KEYS, *(F.lit(v).alias(f"b{k}") for k, v in enumerate(colour)))


def from_array(df: DataFrame, array: str, size: tuple[int, int], n_bands: int = 1) -> DataFrame:
    """Pixels of (image_id, array): samples in row order, bands together. Other lengths are refused."""
    w, h = size
    checked = F.when(F.size(array) == w * h * n_bands, F.col(array)).otherwise(F.raise_error(F.lit("not enough image data")))
    place = F.explode(F.sequence(F.lit(0), F.lit(w * h - 1)))
    rows = df.select("image_id", checked.alias("a")).select("image_id", "a", place.alias("i"))
    return rows.select(
        "image_id", F.lit(w).alias("w"), F.lit(h).alias("h"), (F.col("i") % w).cast("int").alias("x"), F.floor(F.col("i") / w).cast("int").alias("y"),
        *(F.element_at("a", F.col("i") * n_bands + (k + 1)).alias(f"b{k}") for k in range(n_bands)))


#: The modes of arrays, by what a place holds (nothing further, or so many samples) and the samples' type.
ARRAY_MODES = {
    ((), "|b1"): "1", ((), "|u1"): "L", ((), "|i1"): "I", ((), "<u2"): "I", ((), ">u2"): "I", ((), "<i2"): "I", ((), ">i2"): "I", ((), "<u4"): "I",
    ((), ">u4"): "I", ((), "<i4"): "I", ((), ">i4"): "I", ((), "<f4"): "F", ((), ">f4"): "F", ((), "<f8"): "F", ((), ">f8"): "F",
    ((2,), "|u1"): "LA", ((3,), "|u1"): "RGB", ((4,), "|u1"): "RGBA",
}
#: Dimensions that an array of a mode can have; of other modes four.
ARRAY_DIMENSIONS = {"1": 2, "L": 2, "I": 2, "P": 2, "F": 2, "RGB": 3}


def array_layout(shape: Sequence[int], typestr: str, mode: str | None = None) -> tuple[str, int, int]:
    """(mode, w, h) of an array with the shape and type of its interface: rows, columns, and what a place holds. An
    array of one dimension is a column. A mode that is given stands for that of the array."""
    if len(shape) == 0:
        raise IndexError("an image needs rows")
    kind = tuple(shape[2:]), typestr
    if kind not in ARRAY_MODES:
        raise TypeError(f"no mode has places of shape {kind[0]} and type {typestr}")
    mode = mode or ARRAY_MODES[kind]
    limit = ARRAY_DIMENSIONS.get(mode, 4)
    if len(shape) > limit:
        raise ValueError(f"an array of mode {mode} has {limit} dimensions or fewer, this one {len(shape)}")
    return mode, *([*shape, 1][1::-1] if len(shape) == 1 else shape[1::-1])


def from_typed_array(df: DataFrame, data: str, shape: Sequence[int], typestr: str, mode: str | None = None) -> DataFrame:
    """Pixels of (image_id, data): an array's bytes with the shape and type of its interface."""
    mode, w, h = array_layout(shape, typestr, mode)
    n = BANDS[mode]

    @F.pandas_udf("array<double>")
    def values(blocks: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b, np.dtype(typestr)).astype(np.float64) for b in blocks], dtype=object)

    rows = from_array(df.select("image_id", values(data).alias("a")), "a", (w, h), n)
    sample = lambda v: F.when(v != 0, 255).otherwise(0) if mode == "1" else v.cast("float" if mode == "F" else "int")
    return rows.select(*KEYS, *(sample(F.col(b)).alias(b) for b in bands(rows)))


def _byte(data: Column, at: Column) -> Column:
    """The byte at a place counted from 1."""
    return F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("int")


def from_bytes(df: DataFrame, data: str, mode: str, size: tuple[int, int]) -> DataFrame:
    """Pixels of (image_id, data): packed bytes in row order; I as little-endian 32-bit, I;16 as 16-bit
    integers, F as little-endian 32-bit floats, 1 as bits, the first the highest, rows filled to whole bytes."""
    w, h = size
    n = {"I": 4, "F": 4, "I;16": 2}.get(mode) or BANDS[mode]
    length = (w + 7) // 8 * h if mode == "1" else w * h * n
    checked = F.when(F.octet_length(data) == length, F.col(data)).otherwise(F.raise_error(F.lit("not enough image data")))
    if mode == "F":
        @F.pandas_udf("array<float>")
        def floats(blocks: pd.Series) -> pd.Series:
            return pd.Series([np.frombuffer(b, "<f4").astype(np.float32) for b in blocks], dtype=object)

        return from_array(df.select("image_id", floats(checked).alias("d")), "d", size)
    frames = df.select("image_id", checked.alias("d"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    pixels, d = grid(frames), F.col("d")
    first = (F.col("y") * w + F.col("x")) * n + 1
    if mode == "1":
        byte = _byte(d, F.col("y") * ((w + 7) // 8) + F.floor(F.col("x") / 8).cast("int") + 1)
        samples = [F.when(F.floor(byte / F.pow(F.lit(2), 7 - F.col("x") % 8)) % 2 == 1, 255).otherwise(0)]
    elif mode in ("I", "I;16"):
        parts = [_byte(d, first + k).cast("bigint") * (1 << (8 * k)) for k in range(n)]
        total = sum(parts[1:], parts[0])
        samples = [(F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total) if mode == "I" else total).cast("int")]
    else:
        samples = [_byte(d, first + k) for k in range(n)]
    return pixels.select(*KEYS, *(s.alias(f"b{k}") for k, s in enumerate(samples)))


def to_frames(df: DataFrame) -> DataFrame:
    """(image_id, w, h, samples): an array in row order, bands together."""
    own = bands(df)
    rows = df.groupBy("image_id", "w", "h").agg(F.array_sort(F.collect_list(F.struct("y", "x", *own))).alias("p"))
    return rows.select("image_id", "w", "h", F.flatten(F.transform("p", lambda p: F.array(*(p[b] for b in own)))).alias("samples"))


def to_bytes(df: DataFrame, mode: str = "L", rawmode: str | None = None) -> DataFrame:
    """(image_id, w, h, data): packed bytes; BGR and BGRA swap the first and third band."""
    own = bands(df)
    if rawmode in ("BGR", "BGRA"):
        own = [own[2], own[1], own[0], *own[3:]]
    if mode == "1":
        byte = F.sum(F.when(F.col("b0") > 0, F.expr("shiftleft(1, 7 - x % 8)")).otherwise(0))
        packed = df.groupBy("image_id", "w", "h", "y", F.floor(F.col("x") / 8).alias("x")).agg(byte.cast("int").alias("b0"))
        return to_bytes(packed)
    digits = lambda p: F.concat(*(F.lpad(F.hex(p[b]), 2, "0") for b in own))
    if mode == "F":
        @F.pandas_udf("binary")
        def packed_floats(samples: pd.Series) -> pd.Series:
            return pd.Series([np.asarray(x, "<f4").tobytes() for x in samples], dtype=object)

        return to_frames(df.withColumn("b0", F.col("b0").cast("double"))).select("image_id", "w", "h", packed_floats("samples").alias("data"))
    if mode == "I;16":
        digits = lambda p: F.hex(F.reverse(F.unhex(F.lpad(F.hex(p["b0"]), 4, "0"))))
    if mode == "I":
        digits = lambda p: F.hex(F.reverse(F.unhex(F.lpad(F.right(F.hex(p["b0"].cast("bigint")), F.lit(8)), 8, "0"))))
    rows = df.groupBy("image_id", "w", "h").agg(F.array_sort(F.collect_list(F.struct("y", "x", *own))).alias("p"))
    return rows.select("image_id", "w", "h", F.unhex(F.array_join(F.transform("p", digits), "")).alias("data"))


def to_bitmap(df: DataFrame, name: str = "image") -> DataFrame:
    """(image_id, source): mode 1 images as C source of an X bitmap, the leftmost pixel the lowest bit."""
    bit = F.when(F.col("b0") > 0, F.expr("shiftleft(1, x % 8)")).otherwise(0)
    packed = df.groupBy("image_id", "w", "h", "y", F.floor(F.col("x") / 8).alias("c")).agg(F.sum(bit).alias("v"))
    rows = packed.groupBy("image_id", "w", "h").agg(F.array_sort(F.collect_list(F.struct("y", "c", "v"))).alias("p"))
    values = F.array_join(F.transform("p", lambda p: F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(p["v"]), 2, "0")))), ",")
    head = F.format_string(f"#define {name}_width %d\n#define {name}_height %d\nstatic char {name}_bits[] = {{\n%s\n}};", "w", "h", values)
    return rows.select("image_id", head.alias("source"))


def _gradient(spark: SparkSession, level: Column, mode: str) -> DataFrame:
    """256 by 256 of a level in 0..255; mode 1 is white wherever the level is not zero."""
    if mode not in ("1", "L", "P", "I", "F"):
        raise ValueError(f"no gradient of mode {mode}")
    sample = F.when(level > 0, 255).otherwise(0) if mode == "1" else level.cast("float" if mode == "F" else "int")
    return new(spark, (256, 256), [0]).withColumn("b0", sample)


def linear_gradient(spark: SparkSession, mode: str = "L") -> DataFrame:
    """256 by 256, each row its own level."""
    return _gradient(spark, F.col("y"), mode)


def radial_gradient(spark: SparkSession, mode: str = "L") -> DataFrame:
    """256 by 256, by the distance from the middle."""
    dx, dy = F.col("x") - 128, F.col("y") - 128
    return _gradient(spark, F.least(F.lit(255), F.floor(F.sqrt((dx * dx + dy * dy) * 2.0))).cast("int"), mode)


def mandelbrot(spark: SparkSession, size: tuple[int, int], extent: tuple[float, float, float, float], quality: int) -> DataFrame:
    """The step at which a point leaves the circle of radius 10, as a share of quality; 0 if it stays."""
    w, h = size
    x0, y0, x1, y1 = map(float, extent)
    if quality < 2 or x1 < x0 or y1 < y0:
        raise ValueError("bad extent or quality")
    cr = F.lit(x0) + F.col("x") * F.lit((x1 - x0) / max(1, w - 1))
    ci = F.lit(y0) + F.col("y") * F.lit((y1 - y0) / max(1, h - 1))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("k"))

    def step(s: Column, k: Column) -> Column:
        a = s["a"] * s["a"] - s["b"] * s["b"] + cr
        b = s["a"] * s["b"] * 2.0 + ci
        out = a * a + b * b > 100.0
        done = s["k"] > 0
        return F.struct(F.when(done, s["a"]).otherwise(a).alias("a"), F.when(done, s["b"]).otherwise(b).alias("b"),
                        F.when(done, s["k"]).otherwise(F.when(out, k).otherwise(0)).alias("k"))

    left = F.aggregate(F.sequence(F.lit(1), F.lit(quality)), start, step)
    return new(spark, size, [0]).withColumn("b0", F.floor(left["k"] * 255 / quality).cast("int"))

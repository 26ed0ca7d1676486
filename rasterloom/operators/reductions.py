"""Reductions: histograms, statistics, bounds and colours of images. All are grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..relation import bands, with_rows


def samples(df: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(image_id, band, v): a row for each sample, where the mask (L or 1) is not zero."""
    if mask is not None:
        df = with_rows(df, mask.where("b0 <> 0").select("image_id", "x", "y"), ["image_id", "x", "y"], "left_semi")
    own = bands(df)
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("band"), F.col(b).alias("v")) for k, b in enumerate(own))))
    return df.select("image_id", rows.alias("s")).select("image_id", "s.band", "s.v")


def histogram(df: DataFrame, mask: DataFrame | None = None, zeros: bool = False) -> DataFrame:
    """(image_id, band, v, n): how often each level occurs; with zeros, levels that do not occur too."""
    counts = samples(df, mask).groupBy("image_id", "band", "v").agg(F.count(F.lit(1)).alias("n"))
    if not zeros:
        return counts
    levels = df.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(len(bands(df)) - 1))).alias("band"))
    levels = levels.select("image_id", "band", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    return with_rows(levels, counts, ["image_id", "band", "v"], "left").fillna(0, ["n"])


def histogram_scaled(df: DataFrame) -> DataFrame:
    """Modes I and F: (image_id, v, n) with samples scaled between the image's extremes to 0..255. An
    image of one value has no counts."""
    ends = df.groupBy("image_id").agg(F.min("b0").alias("lo"), F.max("b0").alias("hi")).where("lo < hi")
    level = F.least(F.lit(255), F.floor((F.col("b0") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo")))).cast("int")
    return df.join(ends, "image_id").groupBy("image_id", level.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def statistics(df: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(image_id, band) -> count, sum, sum2, mean, median, rms, var, stddev, lo, hi. The variance is the
    population's; the median is the first level with more than half of the samples at or below it."""
    return statistics_of_counts(histogram(df, mask))


def statistics_of_counts(counts: DataFrame) -> DataFrame:
    """statistics() of rows (image_id, band, v, n)."""
    order = Window.partitionBy("image_id", "band").orderBy("v")
    below = counts.withColumns({"below": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("image_id", "band"))})
    v, n = F.col("v").cast("bigint"), F.col("n")
    sums = below.groupBy("image_id", "band").agg(
        F.sum("n").alias("count"), F.sum(v * n).alias("sum"), F.sum(v * v * n).alias("sum2"),
        F.min(F.when(F.col("below") > F.floor(F.col("all") / 2), F.col("v"))).alias("median"),
        F.min("v").alias("lo"), F.max("v").alias("hi"))
    count = F.col("count").cast("double")
    var = (F.col("sum2") - F.col("sum") * F.col("sum") / count) / count
    return sums.withColumns({
        "mean": F.col("sum") / count, "rms": F.sqrt(F.col("sum2") / count), "var": var, "stddev": F.sqrt(var)})


def extrema(df: DataFrame) -> DataFrame:
    """(image_id, band, lo, hi)."""
    own = bands(df)
    wide = df.groupBy("image_id").agg(*(f(b).alias(f"{n}{b}") for b in own for n, f in (("lo", F.min), ("hi", F.max))))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("band"), F.col(f"lo{b}").alias("lo"), F.col(f"hi{b}").alias("hi")) for k, b in enumerate(own))))
    return wide.select("image_id", rows.alias("s")).select("image_id", "s.*")


def bounding_box(df: DataFrame, alpha: bool = False) -> DataFrame:
    """(image_id, left, upper, right, lower) of pixels that are not zero, half-open; only the last band
    counts where it is alpha. An image of zeros has no row."""
    own = bands(df)[-1:] if alpha else bands(df)
    some = df.where(F.greatest(*(F.abs(b) for b in own), F.lit(0)) > 0)
    return some.groupBy("image_id").agg(
        F.min("x").alias("left"), F.min("y").alias("upper"), (F.max("x") + 1).alias("right"), (F.max("y") + 1).alias("lower"))


def projection(df: DataFrame) -> DataFrame:
    """(image_id, axis, at, any): whether a column (axis x) or row (axis y) has a pixel that is not zero."""
    some = F.max(F.when(F.greatest(*(F.col(b) for b in bands(df)), F.lit(0)) > 0, 1).otherwise(0)).alias("any")
    rows = [df.groupBy("image_id", F.lit(axis).alias("axis"), F.col(axis).alias("at")).agg(some) for axis in ("x", "y")]
    return rows[0].unionByName(rows[1])


def colors(df: DataFrame, maxcolors: int = 256) -> DataFrame:
    """(image_id, bands, n) for images of at most maxcolors colours."""
    own = bands(df)
    counts = df.groupBy("image_id", *own).agg(F.count(F.lit(1)).alias("n"))
    few = counts.groupBy("image_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= maxcolors)
    return counts.join(few, "image_id", "left_semi")


def entropy(df: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(image_id, entropy): of levels and bands together, in bits; each share is of all bands' samples."""
    counts = histogram(df, mask)
    total = counts.groupBy("image_id").agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    return counts.join(total, "image_id").groupBy("image_id").agg((-F.sum(p * F.log2(p))).alias("entropy"))


def has_transparency(df: DataFrame) -> DataFrame:
    """(image_id, transparent): whether a pixel's last band is below 255."""
    return df.groupBy("image_id").agg((F.min(bands(df)[-1]) < 255).alias("transparent"))

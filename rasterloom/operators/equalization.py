"""Operators driven by an image's histogram: aggregates that are joined back to the pixels by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.samples import clip
from ..relation import KEYS, bands, with_rows
from .reductions import histogram


def _through(df: DataFrame, levels: DataFrame) -> DataFrame:
    """Samples through (image_id, band, v, to), one join a band; levels without a row stay."""
    own = bands(df)
    for k, b in enumerate(own):
        table = levels.where(F.col("band") == k).select("image_id", F.col("v").alias(b), F.col("to").alias(f"to{k}"))
        df = with_rows(df, table, ["image_id", b], "left")
    return df.select(*KEYS, *(F.coalesce(f"to{k}", b).alias(b) for k, b in enumerate(own)))


def autocontrast(df: DataFrame, cutoff: float = 0, mask: DataFrame | None = None) -> DataFrame:
    """Stretches each band between the levels found at cutoff percent from either end of its samples."""
    counts = histogram(df, mask)
    own = Window.partitionBy("image_id", "band")
    ranked = counts.withColumns({"upto": F.sum("n").over(own.orderBy("v")), "all": F.sum("n").over(own)})
    at = lambda share: F.least(F.floor(F.col("all") * F.lit(share) / 100.0), F.col("all") - 1)
    first = lambda share: F.min(F.when(F.col("upto") > at(share), F.col("v"))).over(own)
    ends = ranked.withColumns({"lo": first(float(cutoff)), "hi": first(100.0 - float(cutoff))}).groupBy("image_id", "band").agg(
        F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    # The mask chooses the ends; all levels of the image are stretched by them.
    levels = with_rows((counts if mask is None else histogram(df)).select("image_id", "band", "v"), ends, ["image_id", "band"])
    scale = F.lit(255.0) / (F.col("hi") - F.col("lo"))
    to = F.when(F.col("hi") <= F.col("lo"), F.col("v")).otherwise(clip(F.col("v") * scale + (-F.col("lo") * scale)))
    return _through(df, levels.withColumn("to", to))


def equalize(df: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Levels by their rank in the band, in steps of (samples - those of the top level) / 255. Bands of one
    level, or whose step is zero, stay."""
    counts = histogram(df, mask)
    own = Window.partitionBy("image_id", "band")
    top = F.max_by("n", "v").over(own)
    ranked = counts.withColumns({
        "before": F.coalesce(F.sum("n").over(own.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "step": F.floor((F.sum("n").over(own) - top) / 255),
        "k": F.count(F.lit(1)).over(own),
    })
    level = F.least(F.lit(255), F.floor((F.floor(F.col("step") / 2) + F.col("before")) / F.col("step"))).cast("int")
    to = F.when((F.col("k") <= 1) | (F.col("step") == 0), F.col("v")).otherwise(level)
    return _through(df, ranked.withColumn("to", to))

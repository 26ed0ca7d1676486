"""Streams of frames: rows (image_id, ts, w, h, samples) as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "image_id bigint, ts timestamp, w int, h int, samples array<int>"


def read_frames(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    """A stream over Parquet files of frames in a folder."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", per_trigger).parquet(path)


def pixels(frames: DataFrame, n_bands: int = 1) -> DataFrame:
    """Pixels of a stream (or table) of frames; point and geometry operators apply to it as to any other."""
    place = F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1))
    rows = frames.select("image_id", "ts", "w", "h", "samples", place.alias("i"))
    return rows.select("image_id", "ts", "w", "h", (F.col("i") % F.col("w")).alias("x"), F.floor(F.col("i") / F.col("w")).cast("int").alias("y"),
                       *(F.col("samples")[F.col("i") * n_bands + k].alias(f"b{k}") for k in range(n_bands)))


def windowed_levels(frames: DataFrame, window: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """(window, n_pixels, mean, lo, hi) of the samples of the frames of each time window; frames that come
    later than ``late`` are left out."""
    rows = frames.withWatermark("ts", late).select("ts", F.explode("samples").alias("v"))
    return rows.groupBy(F.window("ts", window)).agg(
        F.count(F.lit(1)).alias("n_pixels"), F.avg("v").alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))

"""Images from the tables: embeddings as 8 by 8 images, suppliers as 32 by 32 by formula, facts as rasters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..relation import grid
from .pixels import from_array


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Pixels of a task at most, as far as images are of even size.
TASK_PIXELS = 1 << 19


def by_image(images: DataFrame, pixels: int) -> DataFrame:
    """Images (image_id, ...) of so many pixels each, dealt by image over as many tasks as their pixels need, which files of
    a few bytes an image do not tell. What is grouped or joined by image, and by more, stays in its task then."""
    tasks = max(images.sparkSession.sparkContext.defaultParallelism, math.ceil(images.count() * pixels / TASK_PIXELS))
    return images.repartition(tasks, "image_id")


def embeddings_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode F: one image for each vector of 64 numbers."""
    vectors = by_image(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding"), 64)
    return from_array(vectors, "embedding", (8, 8)).withColumn("b0", F.col("b0").cast("double"))


def embeddings_bytes(spark: SparkSession, sf_dir: str, n_bands: int = 1, shift: int = 0) -> DataFrame:
    """Levels of the vectors: a band k of place i is number (i * (2 k + 1) + 5 k) % 64 of the vector. The
    ids are moved by ``shift``, to pair an image with a later one."""
    vectors = by_image(table(spark, sf_dir, "embeddings").select((F.col("vec_id") - shift).alias("image_id"), "embedding"), 64)
    level = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 0.6) * 210))).cast("int")
    bands = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.array(*(level(F.col("embedding")[(i * (2 * k + 1) + 5 * k) % 64]) for k in range(n_bands)))))
    return from_array(vectors.select("image_id", bands.alias("a")), "a", (8, 8), n_bands)


def suppliers(spark: SparkSession, sf_dir: str, n_bands: int = 1) -> DataFrame:
    """32 by 32 images from the suppliers' keys."""
    images = by_image(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id")), 32 * 32)
    pixels = grid(images.select("image_id", F.lit(32).alias("w"), F.lit(32).alias("h")))
    value = lambda k: ((F.col("image_id") * (7 + 4 * k) + F.col("x") * (3 + k) + F.col("y") * (5 - k) + F.floor(F.col("x") * F.col("y") / (k + 2))) % (200 + 20 * k) + 10).cast("int")
    return pixels.select("image_id", "w", "h", "x", "y", *(value(k).alias(f"b{k}") for k in range(n_bands)))


def lineitem_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse 16 by 16 rasters: an image for each supplier, how many lines fall on each place (0..255).
    Places without a line have no row."""
    lines = table(spark, sf_dir, "lineitem")
    keyed = lines.select(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % 16).cast("int").alias("x"), (F.col("l_orderkey") % 16).cast("int").alias("y"))
    counted = keyed.groupBy("image_id", "x", "y").agg(F.least(F.lit(255), F.count(F.lit(1))).cast("int").alias("b0"))
    return counted.select("image_id", F.lit(16).alias("w"), F.lit(16).alias("h"), "x", "y", "b0")


def events_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 by 32 rasters, one for each event type: hour across, bucket of users down."""
    events = table(spark, sf_dir, "events").select(
        F.crc32(F.col("event_type").cast("binary")).alias("image_id"), F.hour("ts").alias("x"), (F.col("user_id") % 32).cast("int").alias("y"))
    counted = events.groupBy("image_id", "x", "y").agg(F.count(F.lit(1)).cast("int").alias("b0"))
    return counted.select("image_id", F.lit(24).alias("w"), F.lit(32).alias("h"), "x", "y", "b0")

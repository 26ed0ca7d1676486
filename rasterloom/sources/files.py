"""Image files. Headers are read by column functions over the binary-file source, so a query for sizes or
formats decodes nothing; PNG, GIF and BMP are decoded, PNG and BMP encoded, in batches of files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..relation import BANDS, bands
from . import image_files
from .codecs import DECODERS, ENCODERS, decode_bmp, decode_png, encode_bmp, encode_png, exif_of, exif_tags  # noqa: F401

#: Format -> the first bytes of its files, in hex.
MAGIC = {
    "PNG": ("89504E470D0A1A0A",), "JPEG": ("FFD8FF",), "GIF": ("474946383761", "474946383961"), "BMP": ("424D",),
    "TIFF": ("49492A00", "4D4D002A"), "ICO": ("00000100",),
}


def format_of(content: Column) -> Column:
    """The format by its first bytes, null if unknown."""
    head = F.hex(F.substring(content, F.lit(1), F.lit(16)))
    found = F.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "WEBP")
    for name, starts in MAGIC.items():
        for start in starts:
            found = found.when(F.startswith(head, F.lit(start)), name)
    return found


def _number(content: Column, at: int, size: int, big: bool) -> Column:
    raw = F.hex(F.substring(content, F.lit(at), F.lit(size)))
    return F.conv(raw if big else F.concat(*(F.substring(raw, 2 * k + 1, 2) for k in reversed(range(size)))), 16, 10).cast("bigint")


def open_images(spark: SparkSession, path: str, formats: Sequence[str] | None = None) -> DataFrame:
    """(image_id, path, format, width, height, content) of the files of known formats, or of those allowed.
    The size is read from the header where it has a fixed place (PNG, GIF, BMP)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return describe(files.select(F.xxhash64("path").alias("image_id"), "path", "content"), formats)


#: Modes that a format holds.
SAVED_MODES = {"PNG": ("1", "L", "LA", "RGB", "RGBA"), "BMP": ("RGB", "RGBA")}


def read_images(spark: SparkSession, path: str, formats: Sequence[str] | None = None, headers: bool = False) -> DataFrame:
    """(path, format, width, height, bytes, modified, content) of the image files in a folder; with ``headers`` contents
    are null and no file is read beyond its header. Only files of the formats allowed are read whole."""
    image_files.register(spark)
    found = spark.read.format(image_files.NAME).option("headers", str(headers).lower()).load(path)
    return found if formats is None else found.where(F.col("format").isin(*formats))


def read_image_stream(spark: SparkSession, path: str, headers: bool = False) -> DataFrame:
    """read_images() of the files that come into a folder."""
    image_files.register(spark)
    return spark.readStream.format(image_files.NAME).option("headers", str(headers).lower()).load(path)


def save_images(df: DataFrame, path: str, mode: str, kind: str = "PNG", overwrite: bool = False) -> None:
    """Writes each image of a pixel relation as a file ``<image_id>.<format>``. All files of the job are there, or none.
    A mode that the format does not hold is refused before any work."""
    if mode not in SAVED_MODES.get(kind, ()):
        raise ValueError(f"cannot write mode {mode} as {kind}")
    if len(bands(df)) != BANDS[mode]:
        raise ValueError(f"{mode} has {BANDS[mode]} bands")
    image_files.register(df.sparkSession)
    name = F.concat(F.col("image_id").cast("string"), F.lit(f".{kind.lower()}"))
    files = encode(df, kind).select(name.alias("name"), "content")
    files.write.format(image_files.NAME).mode("overwrite" if overwrite else "append").save(path)


def describe(files: DataFrame, formats: Sequence[str] | None = None) -> DataFrame:
    """open_images() of rows (image_id, ..., content)."""
    known = files.withColumn("format", format_of(F.col("content"))).where("format is not null")
    if formats is not None:
        known = known.where(F.col("format").isin(*formats))
    c = F.col("content")
    size = lambda png, gif, bmp: F.when(F.col("format") == "PNG", _number(c, png, 4, True)).when(F.col("format") == "GIF", _number(c, gif, 2, False)).when(F.col("format") == "BMP", _number(c, bmp, 4, False)).cast("int")
    return known.withColumns({"width": size(17, 7, 19), "height": size(21, 9, 23)})


def _decoded(content: Column, kind: Column) -> Column:
    @F.pandas_udf("w int, h int, n int, samples array<int>, error string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, kinds in batches:
            rows = []
            for c, k in zip(contents, kinds, strict=True):
                try:
                    w, h, n, samples = DECODERS[k](c)
                    rows.append((w, h, n, samples.astype(np.int32), None))
                except (KeyError, ValueError, TypeError, IndexError, struct.error, zlib.error) as e:
                    rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["w", "h", "n", "samples", "error"]).astype({c: "Int32" for c in ("w", "h", "n")})

    return of(content, kind)


def verify(files: DataFrame) -> DataFrame:
    """files with ok: whether the content can be decoded."""
    return files.withColumn("ok", _decoded(F.col("content"), F.col("format"))["w"].isNotNull())


def undecodable(files: DataFrame, mode: str | None = None) -> DataFrame:
    """(image_id, error) of the files that load_pixels() leaves out: no decoder, bad content, or another mode."""
    found = files.withColumn("d", _decoded(F.col("content"), F.col("format")))
    other = F.lit(None) if mode is None else F.when(F.col("d.n") != BANDS[mode], F.concat(F.lit(f"bands of mode {mode} wanted, found "), F.col("d.n").cast("string")))
    return found.select("image_id", F.coalesce("d.error", other.cast("string")).alias("error")).where("error is not null")


def exif(files: DataFrame) -> DataFrame:
    """(image_id, exif, tags): the raw block and the whole numbers of its first directory, null and empty without."""
    @F.pandas_udf("exif binary, tags map<int,bigint>")
    def of(contents: pd.Series) -> pd.DataFrame:
        blocks, tags = [], []
        for c in contents:
            try:
                block = exif_of(c)
                tags.append(exif_tags(block))
                blocks.append(block)
            except (ValueError, IndexError, struct.error):
                blocks.append(None)
                tags.append({})
        return pd.DataFrame({"exif": pd.Series(blocks, dtype=object), "tags": pd.Series(tags, dtype=object)})

    return files.withColumn("e", of("content")).select("image_id", "e.exif", "e.tags")


def orientations(files: DataFrame) -> DataFrame:
    """(image_id, orientation) for geometry.exif_transpose(); 1 where a file says nothing."""
    return exif(files).select("image_id", F.coalesce(F.try_element_at("tags", F.lit(274)), F.lit(1)).cast("int").alias("orientation"))


def load_pixels(files: DataFrame, mode: str) -> DataFrame:
    """Pixels of the files whose content decodes to as many bands as the mode has."""
    n = BANDS[mode]
    frames = files.withColumn("d", _decoded(F.col("content"), F.col("format"))).where(F.col("d.n") == n)
    place = F.explode(F.sequence(F.lit(0), F.col("d.w") * F.col("d.h") - 1))
    rows = frames.select("image_id", "d.w", "d.h", "d.samples", place.alias("i"))
    return rows.select("image_id", "w", "h", (F.col("i") % F.col("w")).alias("x"), F.floor(F.col("i") / F.col("w")).cast("int").alias("y"),
                       *(F.col("samples")[F.col("i") * n + k].alias(f"b{k}") for k in range(n)))


def encode(df: DataFrame, kind: str = "PNG") -> DataFrame:
    """(image_id, w, h, content): each image as a file."""
    from .pixels import to_frames

    n = len(bands(df))

    @F.pandas_udf("binary")
    def of(w: pd.Series, h: pd.Series, samples: pd.Series) -> pd.Series:
        return pd.Series([ENCODERS[kind](a, b, n, np.asarray(s)) for a, b, s in zip(w, h, samples, strict=True)], dtype=object)

    return to_frames(df).select("image_id", "w", "h", of("w", "h", "samples").alias("content"))


def seek(images: DataFrame, frame: int) -> DataFrame:
    """The images' frame: files have their first frame only."""
    if frame:
        raise EOFError(f"no frame {frame}")
    return images

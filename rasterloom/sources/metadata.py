"""Metadata of image files as relations: EXIF directories with their sub-directories, XMP properties, text chunks.

Where an image's directories begin is found by following pointers (the first directory and the thumbnail's, then EXIF and
GPS, then interoperability); a directory is a row, and its entries are exploded from it. All of it are column
functions over the block's bytes; only the chunks of PNG files are walked by a small helper.

Edge cases: a null block, one of neither byte order, or directories that begin beyond its end have no rows; entries that
reach over the end have a null value. A directory that is pointed to twice, or points to itself, is read once for each name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codecs import PNG_MAGIC

#: Bytes of a value of each EXIF type, and the tags that point to directories.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
POINTERS = {34665: "exif_at", 34853: "gps", 40965: "interop"}
ORIENTATION = 274
#: Entries of a directory at most, by the width of their count.
_ENTRIES = 65_535


def _number(block: Column, at: Column, size: int, big: Column) -> Column:
    raw = F.hex(F.substring(block, (at + 1).cast("int"), F.lit(size)))
    turned = F.concat(*(F.substring(raw, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.when((at >= 0) & (at + size <= F.octet_length(block)), F.conv(F.when(big, raw).otherwise(turned), 16, 10).cast("bigint"))


def _entries(directories: DataFrame) -> DataFrame:
    """(image_id, exif, big, directory, at, tag, kind, count, raw) of directories (image_id, exif, big, directory, at)."""
    block, big = F.col("exif"), F.col("big")
    n = _number(block, F.col("at"), 2, big)
    room = F.floor((F.octet_length("exif") - F.col("at") - 2) / 12)
    rows = directories.where(n.isNotNull()).withColumn("n", F.least(n, room, F.lit(_ENTRIES))).where("n > 0")
    rows = rows.withColumn("e", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    e = F.col("e") * 12 + F.col("at") + 2
    rows = rows.withColumns({"tag": _number(block, e, 2, big), "kind": _number(block, e + 2, 2, big), "count": _number(block, e + 4, 4, big)})
    width = F.create_map(*(F.lit(v) for pair in TYPE_BYTES.items() for v in pair))
    rows = rows.withColumn("size", F.col("count") * F.try_element_at(width, F.col("kind").cast("int")))
    start = F.when(F.col("size") <= 4, e + 8).otherwise(_number(block, e + 8, 4, big))
    fits = (start + F.col("size") <= F.octet_length("exif")) & (F.col("size") <= F.octet_length("exif"))
    raw = F.when(fits, F.substring(block, (start + 1).cast("int"), F.col("size").cast("int")))
    return rows.withColumn("raw", raw).select("image_id", "exif", "big", "directory", "at", F.col("tag").cast("int").alias("tag"), F.col("kind").cast("int").alias("kind"), "count", "raw")


def _pointer(at: str, tag: int) -> Column:
    """Where the directory begins that an entry of the directory at a place points to."""
    block, big, start = F.col("exif"), F.col("big"), F.col(at)
    n = F.least(_number(block, start, 2, big), F.floor((F.octet_length("exif") - start - 2) / 12))
    place = lambda k: start + 2 + 12 * k
    is_it = lambda k: (_number(block, place(k), 2, big) == tag) & (_number(block, place(k) + 2, 2, big) == 4) & (_number(block, place(k) + 4, 4, big) == 1)
    hit = F.get(F.filter(F.sequence(F.lit(0), (n - 1).cast("int")), is_it), F.lit(0))
    return F.when(n > 0, _number(block, place(hit) + 8, 4, big))


def exif_entries(blocks: DataFrame) -> DataFrame:
    """(image_id, directory, tag, kind, count, text, whole, ratio, raw) of the entries of blocks (image_id, exif): text of
    strings, whole numbers of integers, (n, d) of rationals, signed or not, and raw bytes of what is none of those."""
    order = F.substring("exif", 1, 2)
    known = blocks.where(order.isin(b"II", b"MM")).select("image_id", "exif", (order == F.lit(b"MM")).alias("big"))
    at = known.withColumn("image", _number(F.col("exif"), F.lit(4), 4, F.col("big")))
    after = F.col("image") + 2 + 12 * _number(F.col("exif"), F.col("image"), 2, F.col("big"))
    at = at.withColumns({"thumbnail": F.nullif(_number(F.col("exif"), after, 4, F.col("big")), F.lit(0)), **{POINTERS[t]: _pointer("image", t) for t in (34665, 34853)}})
    at = at.withColumn(POINTERS[40965], _pointer("exif_at", 40965))
    names = ("image", "thumbnail", "exif_at", "gps", "interop")
    places = F.array(*(F.struct(F.lit(n.removesuffix("_at")).alias("directory"), F.col(n).alias("at")) for n in names))
    rows = _entries(at.select("image_id", "exif", "big", F.inline(F.filter(places, lambda p: p["at"].isNotNull()))))

    def numbers(width: int, signed: bool, part: int = 0, stride: int | None = None) -> Column:
        step = stride or width
        places = F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))
        value = lambda i: _number(F.col("raw"), i * step + part, width, F.col("big"))
        bound = 1 << (8 * width - 1)
        sign = lambda v: F.when(v >= bound, v - 2 * bound).otherwise(v) if signed else v
        return F.transform(places, lambda i: sign(value(i)))

    kind, some = F.col("kind"), (F.col("count") > 0) & F.col("raw").isNotNull()
    whole = F.when(some & (kind == 3), numbers(2, False)).when(some & (kind == 4), numbers(4, False)).when(some & (kind == 8), numbers(2, True)).when(some & (kind == 9), numbers(4, True))
    whole = F.when(some & (kind == 1), numbers(1, False)).when(some & (kind == 6), numbers(1, True)).otherwise(whole)
    pair = lambda signed: F.arrays_zip(numbers(4, signed, 0, 8).alias("n"), numbers(4, signed, 4, 8).alias("d"))
    ratio = F.when(some & (kind == 5), pair(False)).when(some & (kind == 10), pair(True)).cast("array<struct<n:bigint,d:bigint>>")
    text = F.when(kind == 2, F.substring_index(F.decode("raw", "ISO-8859-1"), "\0", 1))
    raw = F.when(kind.isin(7, 11, 12), F.col("raw"))
    return rows.select("image_id", "directory", "tag", "kind", "count", text.alias("text"), whole.alias("whole"), ratio.alias("ratio"), raw.alias("raw"))


def orientation_of(blocks: DataFrame) -> DataFrame:
    """(image_id, orientation) for geometry.exif_transpose(), 1 to 8; 1 for images whose block says nothing else."""
    said = exif_entries(blocks).where(f"directory = 'image' and tag = {ORIENTATION}").groupBy("image_id").agg(F.max(F.get("whole", F.lit(0))).cast("int").alias("o"))
    valid = F.when(F.col("o").between(1, 8), F.col("o")).otherwise(1)
    return blocks.select("image_id").distinct().join(said, "image_id", "left").select("image_id", F.coalesce(valid, F.lit(1)).alias("orientation"))


def after_transpose(entries: DataFrame) -> DataFrame:
    """Entries of images that have been turned: without their orientation."""
    return entries.where(f"not (directory = 'image' and tag = {ORIENTATION})")


# --- XMP ------------------------------------------------------------------------------------------------------


def xmp(files: DataFrame) -> DataFrame:
    """(image_id, xmp) of files (image_id, content): the first packet's XML, wherever in the file it is; null without."""
    packet = F.regexp_extract(F.decode("content", "ISO-8859-1"), r"(?s)<x:xmpmeta\b.*?</x:xmpmeta\s*>", 0)
    return files.select("image_id", F.when(packet != "", F.decode(F.encode(packet, "ISO-8859-1"), "UTF-8")).alias("xmp"))


def xmp_properties(packets: DataFrame) -> DataFrame:
    """(image_id, property, values) of packets (image_id, xmp): attributes of descriptions, elements with text, and lists."""
    quoted = r"\s([A-Za-z_][\w.\-]*:[A-Za-z_][\w.\-]*)\s*=\s*(\"[^\"]*\"|'[^']*')"
    opening = F.array_join(F.regexp_extract_all("xmp", F.lit(r"<rdf:Description\b[^>]*>"), 0), " ")
    names, values = F.regexp_extract_all(opening, F.lit(quoted), 1), F.regexp_extract_all(opening, F.lit(quoted), 2)
    attributes = F.zip_with(names, values, lambda n, v: F.struct(n.alias("property"), F.array(_plain(F.substring(v, F.lit(2), F.length(v) - 2))).alias("values")))
    simple = r"<([A-Za-z_][\w.\-]*:[A-Za-z_][\w.\-]*)\b[^<>]*>([^<]*)</\1\s*>"
    listed = r"(?s)<([A-Za-z_][\w.\-]*:[A-Za-z_][\w.\-]*)\b[^<>]*>\s*<rdf:(?:Seq|Bag|Alt)\b[^<>]*>(.*?)</rdf:(?:Seq|Bag|Alt)>"
    found = lambda pattern, k: F.regexp_extract_all("xmp", F.lit(pattern), k)
    elements = F.zip_with(found(simple, 1), found(simple, 2), lambda n, v: F.struct(n.alias("property"), F.array(_plain(v)).alias("values")))
    items = lambda v: F.transform(F.regexp_extract_all(v, F.lit(r"<rdf:li\b[^<>]*>([^<]*)</rdf:li>"), 1), _plain)
    lists = F.zip_with(found(listed, 1), found(listed, 2), lambda n, v: F.struct(n.alias("property"), items(v).alias("values")))
    rows = packets.where("xmp is not null").select("image_id", F.inline(F.concat(attributes, elements, lists)))
    return rows.where("property not like 'xmlns:%' and property not in ('rdf:li', 'rdf:about')")


def _plain(v: Column) -> Column:
    """XML text without its five named entities."""
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        v = F.replace(v, F.lit(name), F.lit(c))
    return v


# --- text chunks ----------------------------------------------------------------------------------------------


def _texts(content: bytes) -> Iterator[tuple[str, str]]:
    """(key, value) of a PNG's text chunks, resolution and gamma; ends where the file does."""
    at = 8
    while at + 12 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        data = content[at + 8 : at + 8 + size]
        at += 12 + size
        key, _, rest = data.partition(b"\0")
        name = key.decode("latin-1")
        if kind == b"tEXt":
            yield name, rest.decode("latin-1")
        elif kind == b"zTXt" and rest[:1] == b"\0":
            yield name, zlib.decompress(rest[1:]).decode("latin-1")
        elif kind == b"iTXt" and len(rest) > 2:
            text = rest[2:].split(b"\0", 2)[-1]
            yield name, (zlib.decompress(text) if rest[0] else text).decode("utf-8", "replace")
        elif kind == b"pHYs" and size == 9:
            x, y, unit = struct.unpack(">IIB", data)
            yield ("dpi" if unit else "aspect"), f"{x * (0.0254 if unit else 1):g},{y * (0.0254 if unit else 1):g}"
        elif kind == b"gAMA" and size == 4:
            yield "gamma", f"{struct.unpack('>I', data)[0] / 100000:g}"
        elif kind == b"IEND":
            return


def info(files: DataFrame) -> DataFrame:
    """(image_id, info): a map of what a PNG file says in text; empty for other files. Of equal keys the last counts."""

    @F.pandas_udf("map<string,string>")
    def of(contents: pd.Series) -> pd.Series:
        found = []
        for c in contents:
            own: dict[str, str] = {}
            try:
                if c is not None and c[:8] == PNG_MAGIC:
                    for key, value in _texts(c):
                        own[key] = value
            except (struct.error, zlib.error):
                pass  # what came before the damage stays
            found.append(own)
        return pd.Series(found, dtype=object)

    return files.select("image_id", of("content").alias("info"))

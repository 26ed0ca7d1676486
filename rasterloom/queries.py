"""The library's queries over the tables, each with the SQL of the same rows where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import shapes as SH
from .functions.colors import getrgb
from .operators import binary as B
from .operators import color as C
from .operators import draw as D
from .operators import equalization as E
from .operators import fonts as FO
from .operators import geometry as G
from .operators import neighborhood as N
from .operators import point as P
from .operators import procedural as R
from .operators import reductions as A
from .operators import resample as S
from .plans.chain import Chain
from .relation import sizes
from .sources import files as FL
from .sources import metadata as MD
from .sources import pixels as X
from .sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _level(i: str) -> str:
    return f"CAST(least(255, greatest(0, floor((CAST(embedding[({i}) % 64 + 1] AS DOUBLE) + 0.6) * 210))) AS INTEGER)"


def _emb(name: str, n: int, shift: int = 0) -> str:
    own = ", ".join(f"{_level(f'i * {2 * k + 1} + {5 * k}')} AS b{k}" for k in range(n))
    return f"{name} AS (SELECT vec_id - {shift} AS image_id, 8 AS w, 8 AS h, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, {own} FROM embeddings, range(64) AS t(i))"


def _sup(name: str, n: int) -> str:
    value = lambda k: f"CAST((s_suppkey * {7 + 4 * k} + x * {3 + k} + y * {5 - k} + (x * y) // {k + 2}) % {200 + 20 * k} + 10 AS INTEGER) AS b{k}"
    return f"{name} AS (SELECT s_suppkey AS image_id, 32 AS w, 32 AS h, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {', '.join(value(k) for k in range(n))} FROM supplier, range(32) AS a(x), range(32) AS b(y))"


#: Relations that the SQL may name.
SOURCES = {
    "l": _emb("l", 1), "l2": _emb("l2", 1, 1), "rgb": _emb("rgb", 3), "rgb2": _emb("rgb2", 3, 1), "rgba": _emb("rgba", 4), "rgba2": _emb("rgba2", 4, 1),
    "f": "f AS (SELECT vec_id AS image_id, 8 AS w, 8 AS h, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, CAST(embedding[i + 1] AS DOUBLE) AS b0 FROM embeddings, range(64) AS t(i))",
    "s": _sup("s", 1), "s3": _sup("s3", 3),
    "sparse": "sparse AS (SELECT l_suppkey AS image_id, 16 AS w, 16 AS h, CAST(l_partkey % 16 AS INTEGER) AS x, CAST(l_orderkey % 16 AS INTEGER) AS y, CAST(least(255, count(*)) AS INTEGER) AS b0 FROM lineitem GROUP BY ALL)",
}
READERS: dict[str, Query] = {
    "l": lambda s, d: T.embeddings_bytes(s, d), "l2": lambda s, d: T.embeddings_bytes(s, d, 1, 1),
    "rgb": lambda s, d: T.embeddings_bytes(s, d, 3), "rgb2": lambda s, d: T.embeddings_bytes(s, d, 3, 1),
    "rgba": lambda s, d: T.embeddings_bytes(s, d, 4), "rgba2": lambda s, d: T.embeddings_bytes(s, d, 4, 1),
    "f": T.embeddings_f, "s": T.suppliers, "s3": lambda s, d: T.suppliers(s, d, 3), "sparse": T.lineitem_raster,
}

#: 0..255 of a number, its fraction dropped; whole quotient towards zero; BT.601; blending's product.
CLIP = lambda v: f"CAST(trunc(greatest(0, least(255, {v}))) AS INTEGER)"
ROUND = lambda v: CLIP(f"round({v})")
LUMA = "((b0 * 19595 + b1 * 38470 + b2 * 7471 + 32768) >> 16)"
MULDIV = lambda a, b: f"((((({a}) * ({b}) + 128) >> 8) + ({a}) * ({b}) + 128) >> 8)"
PLACE = "image_id, w, h, x, y"


def query(name: str, sources: str, fn: Callable[..., DataFrame], sql: str | None = None) -> None:
    """Registers fn of the named source relations; sql may name them too."""
    names = sources.split()
    QUERIES[name] = lambda spark, sf_dir: fn(*(READERS[n](spark, sf_dir) for n in names))
    if sql is not None:
        ORACLE_SQL[name] = f"WITH {'RECURSIVE ' * ('_walk' in sql)}{', '.join(SOURCES[n] for n in names)}{'' if sql.startswith(',') else ' '}{sql}"


def _each(fn: Callable[[str], str], n: int, source: str) -> str:
    return f"SELECT {PLACE}, {', '.join(f'{fn(f'b{k}')} AS b{k}' for k in range(n))} FROM {source}"


def _some(samples: list[str], source: str, extra: str = "") -> str:
    return f"SELECT {PLACE}, {', '.join(f'CAST({v} AS INTEGER) AS b{k}' for k, v in enumerate(samples))} FROM {source} {extra}"


# --- point operators ---------------------------------------------------------------------------------

query("op_invert", "rgb", P.invert, _each(lambda b: f"255 - {b}", 3, "rgb"))
query("op_posterize", "rgb", lambda a: P.posterize(a, 3), _each(lambda b: f"{b} & 224", 3, "rgb"))
query("op_solarize", "rgb", lambda a: P.solarize(a, 100), _each(lambda b: f"CASE WHEN {b} >= 100 THEN 255 - {b} ELSE {b} END", 3, "rgb"))
query("op_grayscale", "rgb", P.grayscale, _some([LUMA], "rgb"))
query("op_eval", "l", lambda a: P.evaluate(a, lambda v: v * v / 200), _each(lambda b: CLIP(f"{b} * {b} / 200.0"), 1, "l"))
query("op_point_lut", "rgb", lambda a: P.point(a, [(v * k + 5) % 256 for k in (1, 2, 3) for v in range(256)]), _some(["(b0 + 5) % 256", "(b1 * 2 + 5) % 256", "(b2 * 3 + 5) % 256"], "rgb"))
query("op_brightness", "rgb", lambda a: P.brightness(a, 1.4), _each(lambda b: CLIP(f"{b} * CAST(1.4 AS DOUBLE)"), 3, "rgb"))
query("op_color_saturation", "rgb", lambda a: P.saturation(a, 0.25), _each(lambda b: CLIP(f"{LUMA} * CAST(0.75 AS DOUBLE) + {b} * CAST(0.25 AS DOUBLE)"), 3, "rgb"))
query("op_contrast", "rgb", lambda a: P.contrast(a, 1.5),
      f", m AS (SELECT image_id, CAST(floor(sum({LUMA}) / count(*) + 0.5) AS INTEGER) AS mean FROM rgb GROUP BY image_id) SELECT image_id, w, h, x, y, {', '.join(CLIP(f'mean * CAST(-0.5 AS DOUBLE) + b{k} * CAST(1.5 AS DOUBLE)') + f' AS b{k}' for k in range(3))} FROM rgb JOIN m USING (image_id)")
query("op_colorize", "l", lambda a: P.colorize(a, (0, 10, 200), (250, 120, 0), (90, 90, 90), 20, 220, 100),
      _some([f"CASE WHEN b0 < 20 THEN {k} WHEN b0 < 100 THEN {k} + CAST(floor((b0 - 20) * (90 - {k}) / 80.0) AS INTEGER) WHEN b0 < 220 THEN 90 + CAST(floor((b0 - 100) * ({m} - 90) / 120.0) AS INTEGER) ELSE {m} END" for k, m in ((0, 250), (10, 120), (200, 0))], "l"))
query("op_color3dlut_identity", "rgb", lambda a: P.color_lut_3d(a, (2, 2, 2), P.lut_table((2, 2, 2), lambda r, g, b: (b, r, g))), _some(["b2", "b0", "b1"], "rgb"))

# --- colour conversion --------------------------------------------------------------------------------

query("op_convert_1", "rgb", lambda a: C.convert(a, "RGB", "1"), _some(["CASE WHEN ((b0 * 19595 + b1 * 38470 + b2 * 7471) >> 16) >= 128 THEN 255 ELSE 0 END"], "rgb"))
query("op_convert_i", "rgb", lambda a: C.convert(a, "RGB", "I"), _some([LUMA], "rgb"))
query("op_convert_f", "rgb", lambda a: C.convert(a, "RGB", "F"), f"SELECT {PLACE}, CAST(CAST((b0 * 299 + b1 * 587 + b2 * 114) / CAST(1000 AS DOUBLE) AS FLOAT) AS DOUBLE) AS b0 FROM rgb")
query("op_convert_f_to_l", "f", lambda a: C.convert(a.withColumn("b0", F.col("b0") * 500), "F", "L"), f"SELECT {PLACE}, {CLIP('b0 * 500')} AS b0 FROM f")
query("op_convert_f_to_i", "f", lambda a: C.convert(a.withColumn("b0", F.col("b0") * 500), "F", "I"), f"SELECT {PLACE}, CAST(trunc(b0 * 500) AS INTEGER) AS b0 FROM f")
query("op_convert_cmyk", "rgb", lambda a: C.convert(a, "RGB", "CMYK"), _some(["255 - b0", "255 - b1", "255 - b2", "0"], "rgb"))
query("op_convert_l_cmyk", "l", lambda a: C.convert(a, "L", "CMYK"), _some(["0", "0", "0", "255 - b0"], "l"))
query("op_cmyk_to_rgb", "rgba", lambda a: C.convert(a, "CMYK", "RGB"), _some([f"greatest(0, least(255, 255 - b3 - {MULDIV(f'b{k}', '255 - b3')}))" for k in range(3)], "rgba"))
_T = lambda c, v: f"CAST(trunc(({v}) * CAST({c * 64.0!r} AS DOUBLE) + 0.5) AS INTEGER)"
_Y = lambda r, g, b: f"(({_T(r, 'b0')} + {_T(g, 'b1')} + {_T(b, 'b2')}) >> 6)"
query("op_convert_ycbcr", "rgb", lambda a: C.convert(a, "RGB", "YCbCr"), _some([_Y(0.299, 0.587, 0.114), f"{_Y(-0.16874, -0.33126, 0.5)} + 128", f"{_Y(0.5, -0.41869, -0.08131)} + 128"], "rgb"))
query("op_ycbcr_to_rgb", "rgb", lambda a: C.convert(a, "YCbCr", "RGB"), _some([
    f"greatest(0, least(255, b0 + ({_T(1.402, 'b2 - 128')} >> 6)))", f"greatest(0, least(255, b0 + (({_T(-0.34414, 'b1 - 128')} + {_T(-0.71414, 'b2 - 128')}) >> 6)))", f"greatest(0, least(255, b0 + ({_T(1.772, 'b1 - 128')} >> 6)))"], "rgb"))
_share = lambda v: f"CAST((CAST(top AS FLOAT) - CAST({v} AS FLOAT)) / CAST(top - low AS FLOAT) AS DOUBLE)"
query("op_convert_hsv", "rgb", lambda a: C.convert(a, "RGB", "HSV"), f"""
    , t AS (SELECT *, greatest(b0, b1, b2) AS top, least(b0, b1, b2) AS low FROM rgb),
    u AS (SELECT *, CASE WHEN top = low THEN 0 WHEN b0 = top THEN {_share('b2')} - {_share('b1')} WHEN b1 = top THEN 2.0::DOUBLE + {_share('b0')} - {_share('b2')} ELSE 4.0::DOUBLE + {_share('b1')} - {_share('b0')} END AS turn FROM t),
    v AS (SELECT *, CAST(turn AS FLOAT)::DOUBLE / 6.0 + 1.0 AS z FROM u)
    SELECT image_id, w, h, x, y, CASE WHEN top = low THEN 0 ELSE CAST(floor(CAST(CAST(z - floor(z) AS FLOAT) AS DOUBLE) * 255.0) AS INTEGER) END AS b0,
           CASE WHEN top = low THEN 0 ELSE CAST(floor(CAST(CAST(top - low AS FLOAT) / CAST(top AS FLOAT) AS DOUBLE) * 255.0) AS INTEGER) END AS b1, top AS b2 FROM v""")
query("op_hsv_to_rgb", "rgb", lambda a: C.convert(a, "HSV", "RGB"), """
    , t AS (SELECT *, CAST(b1 AS FLOAT) / CAST(255 AS FLOAT) AS fs, CAST(b0 AS FLOAT) * CAST(6 AS FLOAT) / CAST(255 AS FLOAT) AS turn FROM rgb),
    u AS (SELECT *, CAST(floor(turn) AS INTEGER) % 6 AS k, CAST(turn - floor(turn) AS FLOAT) AS part, CAST(1 AS FLOAT) AS one FROM t),
    v AS (SELECT *, CAST(round(CAST(CAST(b2 AS FLOAT) * (one - fs) AS DOUBLE)) AS INTEGER) AS p, CAST(round(CAST(CAST(b2 AS FLOAT) * (one - fs * part) AS DOUBLE)) AS INTEGER) AS q,
                 CAST(round(CAST(CAST(b2 AS FLOAT) * (one - fs * (one - part)) AS DOUBLE)) AS INTEGER) AS t FROM u)
    SELECT image_id, w, h, x, y, CASE WHEN b1 = 0 THEN b2 ELSE [b2, q, p, p, t, b2][k + 1] END AS b0,
           CASE WHEN b1 = 0 THEN b2 ELSE [t, b2, b2, q, p, p][k + 1] END AS b1, CASE WHEN b1 = 0 THEN b2 ELSE [p, p, t, b2, b2, q][k + 1] END AS b2 FROM v""")
query("op_convert_matrix", "rgb", lambda a: C.convert_matrix(a, (0.412453, 0.357580, 0.180423, 0, 0.212671, 0.715160, 0.072169, 0, 0.019334, 0.119193, 0.950227, 3)),
      _some([ROUND(f"b0 * CAST({r} AS DOUBLE) + b1 * CAST({g} AS DOUBLE) + b2 * CAST({b} AS DOUBLE) + CAST({o} AS DOUBLE)") for r, g, b, o in ((0.412453, 0.357580, 0.180423, 0), (0.212671, 0.715160, 0.072169, 0), (0.019334, 0.119193, 0.950227, 3))], "rgb"))
_PAL = [(k * 3 % 256, k * 5 % 256, k * 7 % 256, 255) for k in range(200)]
query("op_expand_palette", "l", lambda a: C.expand_palette(a, C.put_palette(a.select("image_id").distinct(), _PAL)),
      _some([f"CASE WHEN b0 < 200 THEN b0 * {m} % 256 ELSE 0 END" for m in (3, 5, 7)], "l"))
query("op_remap_palette", "l", lambda a: C.remap_palette(a, [(v * 3 + 40) % 256 for v in range(100)]),
      ", m AS (SELECT (i * 3 + 40) % 256 AS old, min(i) AS new FROM range(100) AS t(i) GROUP BY 1) SELECT image_id, w, h, x, y, CAST(coalesce(new, 0) AS INTEGER) AS b0 FROM l LEFT JOIN m ON old = b0")
_FEW = [(v * 37 % 256, v * 91 % 256, v * 53 % 256) for v in range(24)]
query("op_nearest_palette", "rgb", lambda a: C.nearest_palette(a, _FEW),
      ", p AS (SELECT i, i * 37 % 256 AS r, i * 91 % 256 AS g, i * 53 % 256 AS b FROM range(24) AS t(i)) SELECT image_id, w, h, x, y, CAST(arg_min(i, ((b0 - r) * (b0 - r) + (b1 - g) * (b1 - g) + (b2 - b) * (b2 - b)) * 1000 + i) AS INTEGER) AS b0 FROM rgb, p GROUP BY ALL")
query("op_web_palette", "rgb", C.to_web_palette,
      ", p AS (SELECT i, CASE WHEN i < 10 THEN 0 ELSE (i - 10) % 6 * 51 END AS r, CASE WHEN i < 10 THEN 0 ELSE (i - 10) // 6 % 6 * 51 END AS g, CASE WHEN i < 10 THEN 0 ELSE (i - 10) // 36 * 51 END AS b FROM range(226) AS t(i)), "
      "c AS (SELECT DISTINCT b0 - b0 % 4 AS c0, b1 - b1 % 4 AS c1, b2 - b2 % 4 AS c2 FROM rgb), n AS (SELECT c0, c1, c2, arg_min(i, ((c0 - r) * (c0 - r) + (c1 - g) * (c1 - g) + (c2 - b) * (c2 - b)) * 1000 + i) AS i FROM c, p GROUP BY ALL) "
      f"SELECT {PLACE}, CAST(i AS INTEGER) AS b0 FROM rgb JOIN n ON c0 = b0 - b0 % 4 AND c1 = b1 - b1 % 4 AND c2 = b2 - b2 % 4")
query("op_palette_getcolor", "l", lambda a: C.palette_color(C.put_palette(a.select("image_id").distinct(), _PAL), (30, 50, 70)), "SELECT DISTINCT image_id, CAST(10 AS INTEGER) AS idx FROM l")
query("op_putalpha", "rgb l2", lambda a, m: C.put_alpha(a, m), "SELECT a.image_id, a.w, a.h, a.x, a.y, a.b0, a.b1, a.b2, m.b0 AS b3 FROM rgb a JOIN l2 m USING (image_id, x, y)")
query("op_split", "rgba", C.split, "SELECT image_id, w, h, x, y, CAST(k AS INTEGER) AS band, [b0, b1, b2, b3][k + 1] AS b0 FROM rgba, range(4) AS t(k)")
query("op_getchannel", "rgba", lambda a: C.get_channel(a, 3), "SELECT image_id, w, h, x, y, b3 AS b0 FROM rgba")
query("op_merge", "l l2 rgb", lambda a, b, c: C.merge(a, b, C.get_channel(c, 1)), "SELECT l.image_id, l.w, l.h, l.x, l.y, l.b0, l2.b0 AS b1, rgb.b1 AS b2 FROM l JOIN l2 USING (image_id, x, y) JOIN rgb USING (image_id, x, y)")

# --- geometry -----------------------------------------------------------------------------------------

query("op_crop", "rgb", lambda a: G.crop(a, (2, 1, 7, 6)), "SELECT image_id, 5 AS w, 5 AS h, x - 2 AS x, y - 1 AS y, b0, b1, b2 FROM rgb WHERE x >= 2 AND x < 7 AND y >= 1 AND y < 6")
query("op_crop_outside", "l", lambda a: G.crop(a, (-2, 3, 9, 12)),
      ", i AS (SELECT DISTINCT image_id FROM l) SELECT i.image_id, 11 AS w, 9 AS h, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, coalesce(b0, 0) AS b0 FROM i CROSS JOIN range(11) AS a(gx) CROSS JOIN range(9) AS b(gy) LEFT JOIN l ON l.image_id = i.image_id AND l.x = gx - 2 AND l.y = gy + 3")
_XY = {"FLIP_LEFT_RIGHT": "w - 1 - x, y, w, h", "FLIP_TOP_BOTTOM": "x, h - 1 - y, w, h", "ROTATE_90": "y, w - 1 - x, h, w", "ROTATE_180": "w - 1 - x, h - 1 - y, w, h",
       "ROTATE_270": "h - 1 - y, x, h, w", "TRANSPOSE": "y, x, h, w", "TRANSVERSE": "h - 1 - y, w - 1 - x, h, w"}
for _m, _v in _XY.items():
    _nx, _ny, _nw, _nh = _v.split(", ")
    query(f"op_transpose_{_m.lower()}", "rgb", lambda a, m=_m: G.transpose(G.crop(a, (0, 0, 8, 5)), m),
          f", c AS (SELECT image_id, 8 AS w, 5 AS h, x, y, b0, b1, b2 FROM rgb WHERE y < 5) SELECT image_id, {_nw} AS w, {_nh} AS h, {_nx} AS x, {_ny} AS y, b0, b1, b2 FROM c")
query("op_flip", "l", G.flip, "SELECT image_id, w, h, x, 7 - y AS y, b0 FROM l")
query("op_mirror", "l", G.mirror, "SELECT image_id, w, h, 7 - x AS x, y, b0 FROM l")
query("op_exif_transpose", "l", lambda a: G.exif_transpose(a, a.select("image_id").distinct().withColumn("orientation", (F.col("image_id") % 9).cast("int"))),
      "SELECT image_id, w, h, CASE image_id % 9 WHEN 2 THEN 7 - x WHEN 3 THEN 7 - x WHEN 5 THEN y WHEN 6 THEN 7 - y WHEN 7 THEN 7 - y WHEN 8 THEN y ELSE x END AS x, CASE image_id % 9 WHEN 3 THEN 7 - y WHEN 4 THEN 7 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 7 - x WHEN 8 THEN 7 - x ELSE y END AS y, b0 FROM l")
query("op_offset", "rgb", lambda a: G.offset(a, 3, -2), "SELECT image_id, w, h, (x + 3) % 8 AS x, (y + 6) % 8 AS y, b0, b1, b2 FROM rgb")
query("op_expand", "l", lambda a: G.expand(a, 2, [77]), ", i AS (SELECT DISTINCT image_id FROM l) SELECT i.image_id, 12 AS w, 12 AS h, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, coalesce(b0, 77) AS b0 FROM i CROSS JOIN range(12) AS a(gx) CROSS JOIN range(12) AS b(gy) LEFT JOIN l ON l.image_id = i.image_id AND l.x = gx - 2 AND l.y = gy - 2")
query("op_crop_border", "l", lambda a: G.crop_border(a, 2), "SELECT image_id, 4 AS w, 4 AS h, x - 2 AS x, y - 2 AS y, b0 FROM l WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5")
query("op_reduce", "rgb", lambda a: G.reduce(a, 3, 2), f"SELECT image_id, 3 AS w, 4 AS h, x // 3 AS x, y // 2 AS y, {', '.join(f'CAST(((sum(b{k}) + count(*) // 2) * (16777216 // count(*))) >> 24 AS INTEGER) AS b{k}' for k in range(3))} FROM rgb GROUP BY image_id, x // 3, y // 2")
query("op_reduce_s", "s", lambda a: G.reduce(a, 5), "SELECT image_id, 7 AS w, 7 AS h, x // 5 AS x, y // 5 AS y, CAST(((sum(b0) + count(*) // 2) * (16777216 // count(*))) >> 24 AS INTEGER) AS b0 FROM s GROUP BY image_id, x // 5, y // 5")


def _weights(name: str, size: int, out: int, kernel: str, support: float, lo: float = 0.0, hi: float | None = None) -> str:
    """A CTE (src, o, wt) for a line of a fixed size."""
    hi = float(size) if hi is None else hi
    scale = (hi - lo) / out
    stretch = max(scale, 1.0)
    reach = support * stretch
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    return f"""{name}c AS (SELECT o, {d(lo)} + (o + 0.5::DOUBLE) * {d(scale)} AS c FROM range({out}) AS t(o)),
        {name}k AS (SELECT o, src, (src + 0.5::DOUBLE - c) * {d(1.0 / stretch)} AS v FROM {name}c, range({size}) AS t(src)
                    WHERE src >= greatest(0, trunc(c - {d(reach)} + 0.5)) AND src < least({size}, trunc(c + {d(reach)} + 0.5))),
        {name}v AS (SELECT o, src, {kernel} AS k FROM {name}k),
        {name} AS (SELECT o, src, k / sum(k) OVER (PARTITION BY o) AS wd, CAST(trunc(k / sum(k) OVER (PARTITION BY o) * 4194304 + CASE WHEN k >= 0 THEN 0.5 ELSE -0.5 END) AS BIGINT) AS wt FROM {name}v)"""


_KERNEL = {
    "BOX": ("CASE WHEN v > -0.5 AND v <= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", 0.5),
    "BILINEAR": ("greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(v))", 1.0),
    "HAMMING": ("CASE WHEN v = 0 THEN 1.0::DOUBLE WHEN abs(v) >= 1 THEN 0.0::DOUBLE ELSE sin(abs(v) * pi()) / (abs(v) * pi()) * (cos(abs(v) * pi()) * 0.46::DOUBLE + 0.54::DOUBLE) END", 1.0),
    "BICUBIC": ("CASE WHEN abs(v) < 1 THEN ((abs(v) * 1.5::DOUBLE - 2.5::DOUBLE) * abs(v)) * abs(v) + 1 WHEN abs(v) < 2 THEN (((abs(v) - 5) * abs(v) + 8) * abs(v) - 4) * -0.5::DOUBLE ELSE 0.0::DOUBLE END", 2.0),
    "LANCZOS": ("CASE WHEN v = 0 THEN 1.0::DOUBLE WHEN v >= -3 AND v < 3 THEN sin(v * pi()) / (v * pi()) * (sin(v / 3 * pi()) / (v / 3 * pi())) ELSE 0.0::DOUBLE END", 3.0),
}


def _resized(source: str, n: int, size: int | tuple[int, int], out: tuple[int, int], filt: str, where: tuple = (0.0, None, 0.0, None)) -> str:
    k, support = _KERNEL[filt]
    across, down = (size, size) if isinstance(size, int) else size
    total = lambda b: f"CAST(greatest(0, least(255, (sum({b} * wt) + 2097152) >> 22)) AS INTEGER) AS {b}"
    own = [f"b{i}" for i in range(n)]
    return f""", {_weights('wx', across, out[0], k, support, where[0], where[1])}, {_weights('wy', down, out[1], k, support, where[2], where[3])},
        hx AS (SELECT image_id, o AS x, y, {', '.join(map(total, own))} FROM {source} JOIN wx ON src = x GROUP BY image_id, o, y)
        SELECT image_id, {out[0]} AS w, {out[1]} AS h, CAST(x AS INTEGER) AS x, CAST(o AS INTEGER) AS y, {', '.join(map(total, own))} FROM hx JOIN wy ON src = y GROUP BY image_id, x, o"""


for _f in _KERNEL:
    query(f"op_resize_{_f.lower()}", "rgb", lambda a, f=_f: S.resize(a, (5, 11), f), _resized("rgb", 3, 8, (5, 11), _f))
query("op_resize_nearest", "rgb", lambda a: S.resize(a, (5, 11), "NEAREST"), ", p AS (SELECT image_id, 5 AS w, 11 AS h, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, b0, b1, b2 FROM rgb JOIN range(5) AS a(gx) ON rgb.x = least(7, floor((gx + 0.5) * 8 / 5.0)) JOIN range(11) AS b(gy) ON rgb.y = least(7, floor((gy + 0.5) * 8 / 11.0))) SELECT * FROM p")
query("op_resize_downscale", "s", lambda a: S.resize(a, (9, 7), "BICUBIC"), _resized("s", 1, 32, (9, 7), "BICUBIC"))
query("op_resize_box", "s", lambda a: S.resize(a, (4, 4), "BILINEAR", (8, 8, 24, 24)), _resized("c", 1, 16, (4, 4), "BILINEAR").replace(", ", ", c AS (SELECT image_id, x - 8 AS x, y - 8 AS y, b0 FROM s WHERE x BETWEEN 8 AND 23 AND y BETWEEN 8 AND 23), ", 1))
query("op_resize_f", "f", lambda a: S.resize(a, (4, 4), "BOX", exact=True).withColumn("b0", F.round("b0", 6)),
      "SELECT image_id, 4 AS w, 4 AS h, x // 2 AS x, y // 2 AS y, round(sum(b0 * 0.25), 6) AS b0 FROM f GROUP BY image_id, x // 2, y // 2")
_MULTIPLIED = f", m AS (SELECT {PLACE}, {', '.join(f'{MULDIV(f"b{k}", "b3")} AS b{k}' for k in range(3))}, b3 FROM rgba)"
_DIVIDED = ", ".join(f"CASE WHEN b3 IN (0, 255) THEN b{k} ELSE CAST(least(255, floor(b{k} * 255 / CAST(b3 AS DOUBLE))) AS INTEGER) END AS b{k}" for k in range(3))
query("op_resize_rgba", "rgba", lambda a: S.resize(a, (5, 5), "BILINEAR", alpha=True),
      _MULTIPLIED + _resized("m", 4, 8, (5, 5), "BILINEAR").replace("SELECT image_id, 5 AS w", ", r AS (SELECT image_id, 5 AS w", 1) + f") SELECT {PLACE}, {_DIVIDED}, b3 FROM r")
query("op_thumbnail", "s", lambda a: S.thumbnail(G.crop(a, (0, 0, 32, 20)), (12, 12)),
      ", c AS (SELECT image_id, x, y, b0 FROM s WHERE y < 20)" + _resized("c", 1, (32, 20), (12, 8), "BICUBIC"))
query("op_contain", "s", lambda a: S.contain(a, (20, 12), "BOX"), _resized("s", 1, 32, (12, 12), "BOX"))
query("op_cover", "s", lambda a: S.cover(a, (20, 12), "BOX"), _resized("s", 1, 32, (20, 20), "BOX"))
query("op_fit", "s", lambda a: S.fit(a, (20, 10), "BILINEAR"), _resized("s", 1, 32, (20, 10), "BILINEAR", (0.0, 32.0, 8.0, 24.0)))
query("op_scale", "s", lambda a: S.scale(a, 0.5, "HAMMING"), _resized("s", 1, 32, (16, 16), "HAMMING"))
query("op_pad", "s", lambda a: S.pad(a, (20, 12), [9], "BOX"),
      _resized("s", 1, 32, (12, 12), "BOX").replace("SELECT image_id, 12 AS w, 12 AS h", "SELECT image_id", 1).replace("SELECT image_id, CAST(x", ", q AS (SELECT image_id, CAST(x", 1).replace("FROM hx JOIN wy ON src = y GROUP BY image_id, x, o", "FROM hx JOIN wy ON src = y GROUP BY image_id, x, o), i AS (SELECT DISTINCT image_id FROM q) SELECT i.image_id, 20 AS w, 12 AS h, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, coalesce(b0, 9) AS b0 FROM i CROSS JOIN range(20) AS a(gx) CROSS JOIN range(12) AS b(gy) LEFT JOIN q ON q.image_id = i.image_id AND q.x = gx - 4 AND q.y = gy"))
_COS, _SIN = (f"CAST({round(v, 15)!r} AS DOUBLE)" for v in (math.cos(-math.pi / 6), math.sin(-math.pi / 6)))
_FIX = lambda v: f"CAST(floor(({v}) * 65536 + 0.5::DOUBLE) AS BIGINT)"
query("op_rotate", "s", lambda a: S.rotate(a, 30), f"""
    , i AS (SELECT DISTINCT image_id FROM s), o AS (SELECT -16 * {_COS} + -16 * {_SIN} + 16 AS c, -16 * -({_SIN}) + -16 * {_COS} + 16 AS f),
    g AS (SELECT image_id, gx, gy, floor((gx * {_FIX(_COS)} + gy * {_FIX(_SIN)} + {_FIX(f'c + {_COS} * 0.5::DOUBLE + {_SIN} * 0.5::DOUBLE')}) / 65536.0::DOUBLE) AS px,
          floor((gx * {_FIX(f'-({_SIN})')} + gy * {_FIX(_COS)} + {_FIX(f'f + -({_SIN}) * 0.5::DOUBLE + {_COS} * 0.5::DOUBLE')}) / 65536.0::DOUBLE) AS py FROM i, o, range(32) AS a(gx), range(32) AS b(gy))
    SELECT g.image_id, 32 AS w, 32 AS h, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, coalesce(b0, 0) AS b0 FROM g LEFT JOIN s ON s.image_id = g.image_id AND s.x = px AND s.y = py""")
_COS, _SIN = (f"CAST({round(v, 15)!r} AS DOUBLE)" for v in (math.cos(-math.pi / 4), math.sin(-math.pi / 4)))
query("op_rotate_expand_bilinear", "l", lambda a: S.rotate(a, 45, "BILINEAR", True), f"""
    , i AS (SELECT DISTINCT image_id FROM l), o AS (SELECT -2 * {_COS} + -2 * {_SIN} + (-4 * {_COS} + -4 * {_SIN} + 4) AS c, -2 * -({_SIN}) + -2 * {_COS} + (-4 * -({_SIN}) + -4 * {_COS} + 4) AS f),
    g AS (SELECT image_id, gx, gy, {_COS} * (gx + 0.5::DOUBLE) + {_SIN} * (gy + 0.5::DOUBLE) + c AS sx, -({_SIN}) * (gx + 0.5::DOUBLE) + {_COS} * (gy + 0.5::DOUBLE) + f AS sy FROM i, o, range(12) AS a(gx), range(12) AS b(gy)),
    n AS (SELECT *, greatest(0, least(7, floor(sx - 0.5))) AS x0, greatest(0, least(7, floor(sx - 0.5) + 1)) AS x1, greatest(0, least(7, floor(sy - 0.5))) AS y0, greatest(0, least(7, floor(sy - 0.5) + 1)) AS y1,
          (sx - 0.5::DOUBLE) - floor(sx - 0.5::DOUBLE) AS fx, (sy - 0.5::DOUBLE) - floor(sy - 0.5::DOUBLE) AS fy FROM g WHERE sx >= 0 AND sy >= 0 AND sx < 8 AND sy < 8),
    v AS (SELECT n.image_id, gx, gy, p.b0 + (q.b0 - p.b0) * fx AS up, r.b0 + (t.b0 - r.b0) * fx AS down, fy FROM n
          JOIN l p ON p.image_id = n.image_id AND p.x = x0 AND p.y = y0 JOIN l q ON q.image_id = n.image_id AND q.x = x1 AND q.y = y0
          JOIN l r ON r.image_id = n.image_id AND r.x = x0 AND r.y = y1 JOIN l t ON t.image_id = n.image_id AND t.x = x1 AND t.y = y1)
    SELECT g.image_id, 12 AS w, 12 AS h, CAST(g.gx AS INTEGER) AS x, CAST(g.gy AS INTEGER) AS y, CASE WHEN v.image_id IS NULL THEN 0 ELSE {CLIP('up + (down - up) * fy')} END AS b0 FROM g LEFT JOIN v ON v.image_id = g.image_id AND v.gx = g.gx AND v.gy = g.gy""")
query("op_rotate_90", "l", lambda a: S.rotate(a, 90, expand=True), "SELECT image_id, w, h, y AS x, 7 - x AS y, b0 FROM l")
query("op_transform_affine", "l", lambda a: S.transform_affine(a, (8, 8), (0.5, 0.25, 1, -0.25, 1.5, 0)), """
    , i AS (SELECT DISTINCT image_id FROM l), g AS (SELECT image_id, gx, gy, (gx * 32768 + gy * 16384 + 90112) >> 16 AS px, (gx * -16384 + gy * 98304 + 40960) >> 16 AS py FROM i, range(8) AS a(gx), range(8) AS b(gy))
    SELECT g.image_id, 8 AS w, 8 AS h, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, coalesce(b0, 0) AS b0 FROM g LEFT JOIN l ON l.image_id = g.image_id AND l.x = px AND l.y = py""")
query("op_transform_affine_bilinear", "l", lambda a: S.transform_affine(a, (8, 8), (0.5, 0, 1, 0, 0.5, 1), "BILINEAR"), """
    , i AS (SELECT DISTINCT image_id FROM l), g AS (SELECT image_id, gx, gy, (gx + 0.5) * 0.5 + 0.5 AS sx, (gy + 0.5) * 0.5 + 0.5 AS sy FROM i, range(8) AS a(gx), range(8) AS b(gy))
    SELECT g.image_id, 8 AS w, 8 AS h, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, CAST(trunc(p.b0 + (q.b0 - p.b0) * (sx - floor(sx)) + ((r.b0 + (s.b0 - r.b0) * (sx - floor(sx))) - (p.b0 + (q.b0 - p.b0) * (sx - floor(sx)))) * (sy - floor(sy))) AS INTEGER) AS b0
    FROM g JOIN l p ON p.image_id = g.image_id AND p.x = floor(sx) AND p.y = floor(sy) JOIN l q ON q.image_id = g.image_id AND q.x = floor(sx) + 1 AND q.y = floor(sy)
    JOIN l r ON r.image_id = g.image_id AND r.x = floor(sx) AND r.y = floor(sy) + 1 JOIN l s ON s.image_id = g.image_id AND s.x = floor(sx) + 1 AND s.y = floor(sy) + 1""")
query("op_transform_perspective", "l", lambda a: S.transform_perspective(a, (8, 8), (1, 0, 0, 0, 1, 0, 0.0625, 0)), """
    , i AS (SELECT DISTINCT image_id FROM l), g AS (SELECT image_id, gx, gy, floor((gx + 0.5::DOUBLE) / ((gx + 0.5::DOUBLE) * 0.0625::DOUBLE + 1)) AS px, floor((gy + 0.5::DOUBLE) / ((gx + 0.5::DOUBLE) * 0.0625::DOUBLE + 1)) AS py FROM i, range(8) AS a(gx), range(8) AS b(gy))
    SELECT g.image_id, 8 AS w, 8 AS h, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, coalesce(b0, 0) AS b0 FROM g LEFT JOIN l ON l.image_id = g.image_id AND l.x = px AND l.y = py""")
query("op_transform_quad", "l", lambda a: S.transform_quad(a, (4, 4), (0, 0, 0, 8, 8, 8, 8, 0)), "SELECT image_id, 4 AS w, 4 AS h, x // 2 AS x, y // 2 AS y, b0 FROM l WHERE x % 2 = 1 AND y % 2 = 1")
query("op_transform_mesh", "l", lambda a: S.transform_mesh(a, (8, 8), [((0, 0, 4, 8), (4, 0, 4, 8, 8, 8, 8, 0)), ((4, 0, 8, 4), (0, 0, 0, 4, 4, 4, 4, 0))], fill=[1]),
      "SELECT image_id, w, h, x, y, CASE WHEN x >= 4 AND y >= 4 THEN 1 WHEN x < 4 THEN (SELECT b0 FROM l m WHERE m.image_id = l.image_id AND m.x = l.x + 4 AND m.y = l.y) ELSE (SELECT b0 FROM l m WHERE m.image_id = l.image_id AND m.x = l.x - 4 AND m.y = l.y) END AS b0 FROM l")


def _cubic(v: list[str], d: str) -> str:
    a, b, c, e = v
    return f"({b} + {d} * (({c} - {a}) + {d} * ((2 * ({a} - {b}) + {c} - {e}) + {d} * ({b} - {a} + {e} - {c}))))"


def _bicubic(source: str, n: int, size: int, out: tuple[int, int], places: str, fill: str = "0", extra: str = "", back: Callable[[int], str] = "b{}".format) -> str:
    """SQL of sixteen taps around (sx, sy), which places gives for gx and gy (with i, o in scope)."""
    near = lambda v, k: f"greatest(0, least({size - 1}, floor({v} - 0.5::DOUBLE) + {k} - 1))"
    taps = ", ".join(f"CAST(max(CASE WHEN i = {i} AND j = {j} THEN b{k} END) AS DOUBLE) AS t{k}{i}{j}" for k in range(n) for j in range(4) for i in range(4))
    value = lambda k: CLIP(_cubic([_cubic([f"t{k}{i}{j}" for i in range(4)], "fx") for j in range(4)], "fy"))
    own = ", ".join(f"CASE WHEN v.image_id IS NULL THEN {fill} ELSE {value(k)} END AS b{k}" for k in range(n))
    return f"""{extra}, i AS (SELECT DISTINCT image_id FROM {source}), {places},
    n AS (SELECT image_id, gx, gy, i, j, {near('sx', 'i')} AS px, {near('sy', 'j')} AS py, (sx - 0.5::DOUBLE) - floor(sx - 0.5::DOUBLE) AS fx, (sy - 0.5::DOUBLE) - floor(sy - 0.5::DOUBLE) AS fy
          FROM g, range(4) AS a(i), range(4) AS b(j) WHERE sx >= 0 AND sy >= 0 AND sx < {size} AND sy < {size}),
    v AS (SELECT n.image_id, gx, gy, fx, fy, {taps} FROM n JOIN {source} p ON p.image_id = n.image_id AND p.x = px AND p.y = py GROUP BY ALL),
    z AS (SELECT g.image_id, {out[0]} AS w, {out[1]} AS h, CAST(g.gx AS INTEGER) AS x, CAST(g.gy AS INTEGER) AS y, {own} FROM g LEFT JOIN v ON v.image_id = g.image_id AND v.gx = g.gx AND v.gy = g.gy)
    SELECT {PLACE}, {', '.join(f'CAST({back(k)} AS INTEGER) AS b{k}' for k in range(n))} FROM z"""


_COS, _SIN = (f"CAST({round(v, 15)!r} AS DOUBLE)" for v in (math.cos(-math.pi / 6), math.sin(-math.pi / 6)))
_TURN = lambda n: f"""o AS (SELECT -{n} * {_COS} + -{n} * {_SIN} + {n} AS c, -{n} * -({_SIN}) + -{n} * {_COS} + {n} AS f),
    g AS (SELECT image_id, gx, gy, {_COS} * (gx + 0.5::DOUBLE) + {_SIN} * (gy + 0.5::DOUBLE) + c AS sx, -({_SIN}) * (gx + 0.5::DOUBLE) + {_COS} * (gy + 0.5::DOUBLE) + f AS sy FROM i, o, range({2 * n}) AS a(gx), range({2 * n}) AS b(gy))"""  # noqa: E731
query("op_rotate_bicubic", "s", lambda a: S.rotate(a, 30, "BICUBIC", fill=[7]), _bicubic("s", 1, 32, (32, 32), _TURN(16), "7"))
query("op_rotate_bicubic_rgba", "rgba", lambda a: S.rotate(a, 30, "BICUBIC", alpha=True),
      _bicubic("m", 4, 8, (8, 8), _TURN(4), extra=_MULTIPLIED, back=lambda k: "b3" if k == 3 else f"CASE WHEN b3 IN (0, 255) THEN b{k} ELSE least(255, b{k} * 255 // greatest(b3, 1)) END"))
query("op_transform_affine_bicubic", "rgb", lambda a: S.transform_affine(a, (11, 9), (0.5, 0.25, 1, -0.25, 0.75, 2.25), "BICUBIC"),
      _bicubic("rgb", 3, 8, (11, 9), "g AS (SELECT image_id, gx, gy, 0.5::DOUBLE * (gx + 0.5::DOUBLE) + 0.25::DOUBLE * (gy + 0.5::DOUBLE) + 1 AS sx, -0.25::DOUBLE * (gx + 0.5::DOUBLE) + 0.75::DOUBLE * (gy + 0.5::DOUBLE) + 2.25::DOUBLE AS sy FROM i, range(11) AS a(gx), range(9) AS b(gy))"))
query("op_transform_perspective_bicubic", "l", lambda a: S.transform_perspective(a, (8, 8), (1, 0, 0, 0, 1, 0, 0.0625, 0), "BICUBIC"),
      _bicubic("l", 1, 8, (8, 8), "g AS (SELECT image_id, gx, gy, (gx + 0.5::DOUBLE) / ((gx + 0.5::DOUBLE) * 0.0625::DOUBLE + 1) AS sx, (gy + 0.5::DOUBLE) / ((gx + 0.5::DOUBLE) * 0.0625::DOUBLE + 1) AS sy FROM i, range(8) AS a(gx), range(8) AS b(gy))"))
query("op_transform_quad_bicubic", "l", lambda a: S.transform_quad(a, (4, 4), (1, 0, 0, 8, 8, 7, 6, 1), "BICUBIC"),
      _bicubic("l", 1, 8, (4, 4), "g AS (SELECT image_id, gx, gy, 1 + (gx + 0.5::DOUBLE) * 1.25::DOUBLE + (gy + 0.5::DOUBLE) * -0.25::DOUBLE + (gx + 0.5::DOUBLE) * (gy + 0.5::DOUBLE) * 0.1875::DOUBLE AS sx, (gx + 0.5::DOUBLE) * 0.25::DOUBLE + (gy + 0.5::DOUBLE) * 2 + (gx + 0.5::DOUBLE) * (gy + 0.5::DOUBLE) * -0.125::DOUBLE AS sy FROM i, range(4) AS a(gx), range(4) AS b(gy))"))

# --- two images ---------------------------------------------------------------------------------------

_D = lambda a, b: f"trunc(({a}) / CAST({b} AS DOUBLE))"
_HARD = lambda x, y: f"CASE WHEN {y} < 128 THEN {_D(f'{x} * {y}', 127)} ELSE 255 - {_D(f'(255 - {y}) * (255 - {x})', 127)} END"
_PAIRS: dict[str, tuple[Callable, Callable[[str, str], str]]] = {
    "add": (lambda a, b: B.add(a, b, 2, 5), lambda x, y: CLIP(f"({x} + {y}) / CAST(2 AS DOUBLE) + 5")),
    "subtract": (lambda a, b: B.subtract(a, b, 1.5, 100), lambda x, y: CLIP(f"({x} - {y}) / CAST(1.5 AS DOUBLE) + 100")),
    "multiply": (B.multiply, lambda x, y: _D(f"{x} * {y}", 255)), "screen": (B.screen, lambda x, y: f"255 - {_D(f'(255 - {x}) * (255 - {y})', 255)}"),
    "darker": (B.darker, lambda x, y: f"least({x}, {y})"), "lighter": (B.lighter, lambda x, y: f"greatest({x}, {y})"), "difference": (B.difference, lambda x, y: f"abs({x} - {y})"),
    "overlay": (B.overlay, lambda x, y: CLIP(_HARD(y, x))), "hard_light": (B.hard_light, lambda x, y: CLIP(_HARD(x, y))),
    "soft_light": (B.soft_light, lambda x, y: CLIP(f"{_D(f'(255 - {x}) * {x} * {y}', 65536)} + {_D(f'{x} * (255 - {_D(f'(255 - {x}) * (255 - {y})', 255)})', 255)}")),
    "add_modulo": (B.add_modulo, lambda x, y: f"({x} + {y}) % 256"), "subtract_modulo": (B.subtract_modulo, lambda x, y: f"({x} - {y} + 256) % 256"),
    "logical_and": (B.logical_and, lambda x, y: f"{x} & {y}"), "logical_or": (B.logical_or, lambda x, y: f"{x} | {y}"), "logical_xor": (B.logical_xor, lambda x, y: f"xor({x}, {y})"),
    "blend": (lambda a, b: B.blend(a, b, 0.3), lambda x, y: CLIP(f"{x} + CAST(0.3 AS DOUBLE) * ({y} - {x})")),
}
for _n, (_fn, _sql) in _PAIRS.items():
    query(f"op_chops_{_n}" if _n != "blend" else "op_blend", "rgb rgb2", _fn,
          "SELECT a.image_id, a.w, a.h, a.x, a.y, " + ", ".join(f"CAST({_sql(f'a.b{k}', f'b.b{k}')} AS INTEGER) AS b{k}" for k in range(3)) + " FROM rgb a JOIN rgb2 b USING (image_id, x, y)")
query("op_chops_constant", "l", lambda a: X.constant(a.select("image_id").distinct(), (3, 2), [42]), "SELECT DISTINCT image_id, 3 AS w, 2 AS h, x, y, 42 AS b0 FROM l WHERE x < 3 AND y < 2")
_MIX = lambda s, d, m: f"CAST(trunc(({s} * {m} + {d} * (255 - {m}) + 127) / CAST(255 AS DOUBLE)) AS INTEGER)"
query("op_composite", "rgb rgb2 l", lambda a, b, m: B.composite(a, b, m),
      "SELECT b.image_id, b.w, b.h, b.x, b.y, " + ", ".join(f"coalesce({_MIX(f'a.b{k}', f'b.b{k}', 'm.b0')}, b.b{k}) AS b{k}" for k in range(3)) + " FROM rgb2 b LEFT JOIN rgb a USING (image_id, x, y) LEFT JOIN l m USING (image_id, x, y)")
query("op_paste", "rgb rgb2", lambda a, b: B.paste(a, b, (3, -2)),
      "SELECT a.image_id, a.w, a.h, a.x, a.y, " + ", ".join(f"coalesce(b.b{k}, a.b{k}) AS b{k}" for k in range(3)) + " FROM rgb a LEFT JOIN rgb2 b ON a.image_id = b.image_id AND a.x = b.x + 3 AND a.y = b.y - 2")
query("op_paste_mask", "rgb rgb2 l", lambda a, b, m: B.paste(a, b, (1, 1), m),
      "SELECT a.image_id, a.w, a.h, a.x, a.y, " + ", ".join(f"coalesce({_MIX(f'b.b{k}', f'a.b{k}', 'm.b0')}, a.b{k}) AS b{k}" for k in range(3)) + " FROM rgb a LEFT JOIN rgb2 b ON a.image_id = b.image_id AND a.x = b.x + 1 AND a.y = b.y + 1 LEFT JOIN l m ON a.image_id = m.image_id AND a.x = m.x + 1 AND a.y = m.y + 1")
query("op_paste_color", "rgb l", lambda a, m: B.paste_color(a, (9, 99, 199), (2, 2, 6, 5), m),
      "SELECT a.image_id, a.w, a.h, a.x, a.y, " + ", ".join(f"CASE WHEN a.x BETWEEN 2 AND 5 AND a.y BETWEEN 2 AND 4 THEN {_MIX(str(v), f'a.b{k}', 'm.b0')} ELSE a.b{k} END AS b{k}" for k, v in enumerate((9, 99, 199))) + " FROM rgb a LEFT JOIN l m ON a.image_id = m.image_id AND a.x = m.x + 2 AND a.y = m.y + 2")
_OUT = "(c3 / 255.0::DOUBLE + b3 / 255.0::DOUBLE * (1 - c3 / 255.0::DOUBLE))"
query("op_alpha_composite", "rgba rgba2", B.alpha_composite,
      f", j AS (SELECT a.*, b.b0 AS c0, b.b1 AS c1, b.b2 AS c2, b.b3 AS c3 FROM rgba a JOIN rgba2 b USING (image_id, x, y)) SELECT {PLACE}, " + ", ".join(
          f"CASE WHEN {_OUT} > 0 THEN {ROUND(f'(c{k} * (c3 / 255.0::DOUBLE) + b{k} * (b3 / 255.0::DOUBLE) * (1 - c3 / 255.0::DOUBLE)) / {_OUT}')} ELSE b{k} END AS b{k}" for k in range(3)) + f", CASE WHEN {_OUT} > 0 THEN {ROUND(f'{_OUT} * 255')} ELSE b3 END AS b3 FROM j")
query("op_premultiply", "rgba", B.premultiplied, _some([*(MULDIV(f"b{k}", "b3") for k in range(3)), "b3"], "rgba"))
query("op_putdata", "l", lambda a: D.put_data(a, a.groupBy("image_id").agg(F.sequence(F.lit(0), F.lit(39)).alias("values")), 3.5, 7), f"SELECT {PLACE}, CASE WHEN y * 8 + x < 40 THEN {CLIP('(y * 8 + x) * 3.5 + 7')} ELSE b0 END AS b0 FROM l")
query("op_putpixel", "rgb", lambda a: D.put_pixel(a, (3, 4), (1, 2, 3)), _some([f"CASE WHEN x = 3 AND y = 4 THEN {k + 1} ELSE b{k} END" for k in range(3)], "rgb"))
query("op_getpixel", "rgb", lambda a: D.get_pixel(a, (3, 4)), "SELECT image_id, b0, b1, b2 FROM rgb WHERE x = 3 AND y = 4")

# --- neighbourhoods -----------------------------------------------------------------------------------


def _kernel_sql(source: str, n: int, kernel: tuple, scale: float, offset: float, size: int) -> str:
    side = 3 if len(kernel) == 9 else 5
    r = side // 2
    cells = ", ".join(f"({i - r}, {r - j}, {kernel[j * side + i]})" for j in range(side) for i in range(side))
    total = lambda b: CLIP(f"sum(q.{b} * k) / CAST({scale} AS DOUBLE) + {offset} + 0.5")
    own = [f"b{i}" for i in range(n)]
    inside = f"p.x BETWEEN {r} AND {size - 1 - r} AND p.y BETWEEN {r} AND {size - 1 - r}"
    return f""", kc AS (SELECT * FROM (VALUES {cells}) AS t(dx, dy, k)), fs AS (SELECT p.image_id, p.x, p.y, {', '.join(f'{total(b)} AS {b}' for b in own)} FROM {source} p, kc JOIN {source} q ON true WHERE q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy AND {inside} GROUP BY p.image_id, p.x, p.y)
        SELECT p.image_id, p.w, p.h, p.x, p.y, {', '.join(f'coalesce(fs.{b}, p.{b}) AS {b}' for b in own)} FROM {source} p LEFT JOIN fs USING (image_id, x, y)"""


for _n, (_k, _s, _o) in N.KERNELS.items():
    query(f"op_filter_{_n.lower()}", "rgb", lambda a, n=_n: N.named_filter(a, n), _kernel_sql("rgb", 3, _k, _s, _o, 8))
_K5 = tuple((i * 7 + 3) % 5 - 1 for i in range(25))
query("op_filter_kernel", "l", lambda a: N.kernel_filter(a, _K5, None, 10), _kernel_sql("l", 1, _K5, sum(_K5), 10, 8))
query("op_filter_i", "l", lambda a: N.kernel_filter(a.withColumn("b0", F.col("b0") * 1000), N.KERNELS["SHARPEN"][0], 16, 0, None),
      _kernel_sql("li", 1, N.KERNELS["SHARPEN"][0], 16, 0, 8).replace(", kc", ", li AS (SELECT * REPLACE (b0 * 1000 AS b0) FROM l), kc", 1).replace("least(255, sum(q.b0 * k) / CAST(16 AS DOUBLE) + 0 + 0.5)", "sum(q.b0 * k) / CAST(16 AS DOUBLE) + 0 + 0.5"))
query("op_sharpness", "rgb", lambda a: N.sharpness(a, 2.0),
      _kernel_sql("rgb", 3, N.KERNELS["SMOOTH"][0], 13, 0, 8).replace("SELECT p.image_id, p.w, p.h, p.x, p.y, coalesce(fs.b0, p.b0) AS b0, coalesce(fs.b1, p.b1) AS b1, coalesce(fs.b2, p.b2) AS b2", "SELECT p.image_id, p.w, p.h, p.x, p.y, " + ", ".join(f"{CLIP(f'coalesce(fs.b{k}, p.b{k}) * CAST(-1 AS DOUBLE) + p.b{k} * CAST(2 AS DOUBLE)')} AS b{k}" for k in range(3))))
_CLAMPED = lambda r: f", o AS (SELECT dx - {r} AS dx, dy - {r} AS dy FROM range({2 * r + 1}) AS a(dx), range({2 * r + 1}) AS b(dy)), n AS (SELECT p.image_id, p.w, p.h, p.x, p.y, list_sort(list(q.b0)) AS v FROM l p CROSS JOIN o JOIN l q ON q.image_id = p.image_id AND q.x = greatest(0, least(7, p.x + dx)) AND q.y = greatest(0, least(7, p.y + dy)) GROUP BY ALL) "
query("op_median_filter", "l", lambda a: N.median_filter(a, 3), _CLAMPED(1) + f"SELECT {PLACE}, v[5] AS b0 FROM n")
query("op_rank_filter", "l", lambda a: N.rank_filter(a, 5, 20), _CLAMPED(2) + f"SELECT {PLACE}, v[21] AS b0 FROM n")
query("op_min_filter", "l", lambda a: N.min_filter(a, 5), _CLAMPED(2) + f"SELECT {PLACE}, v[1] AS b0 FROM n")
query("op_max_filter", "l", lambda a: N.max_filter(a, 3), _CLAMPED(1) + f"SELECT {PLACE}, v[9] AS b0 FROM n")
query("op_mode_filter", "l", lambda a: N.mode_filter(P.posterize(a, 2), 3), """
    , z AS (SELECT * REPLACE (b0 & 192 AS b0) FROM l), c AS (SELECT p.image_id, p.x, p.y, q.b0 AS v, count(*) AS n FROM z p JOIN z q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY ALL),
    m AS (SELECT image_id, x, y, max(n) AS n, arg_max(v, n * 1000 - v) AS v FROM c GROUP BY ALL) SELECT z.image_id, z.w, z.h, z.x, z.y, CASE WHEN n > 2 THEN v ELSE b0 END AS b0 FROM z JOIN m USING (image_id, x, y)""")


def _box_sql(source: str, radius: float, passes: int, size: int) -> str:
    import numpy as np

    r = int(radius)
    whole = int(np.float32(1 << 24) / np.float32(np.float32(radius) * np.float32(2) + np.float32(1)))
    part = ((1 << 24) - (2 * r + 1) * whole) // 2
    steps, last = [], source
    for axis, other in (("x", "y"), ("y", "x")):
        for _ in range(passes):
            now = f"bx{len(steps)}"
            near = f"q.image_id = p.image_id AND q.{other} = p.{other} AND q.{axis} = greatest(0, least({size - 1}, p.{axis} + d))"
            steps.append(f"{now} AS (SELECT p.image_id, p.w, p.h, p.x, p.y, CAST((sum(q.b0 * CASE WHEN abs(d) <= {r} THEN {whole} ELSE {part} END) + 8388608) >> 24 AS INTEGER) AS b0 FROM {last} p CROSS JOIN (SELECT d - {r + 1} AS d FROM range({2 * r + 3}) AS t(d)) JOIN {last} q ON {near} GROUP BY ALL)")
            last = now
    return f", {', '.join(steps)} SELECT * FROM {last}"


query("op_box_blur", "l", lambda a: N.box_blur(a, 2), _box_sql("l", 2, 1, 8))
query("op_gaussian_blur", "l", lambda a: N.gaussian_blur(a, 1.3), _box_sql("l", N.gaussian_radius(1.3), 3, 8))
query("op_unsharp_mask", "l", lambda a: N.unsharp_mask(a, 1.3, 150, 3), _box_sql("l", N.gaussian_radius(1.3), 3, 8).replace("SELECT * FROM bx5", f"SELECT l.image_id, l.w, l.h, l.x, l.y, CASE WHEN abs(l.b0 - g.b0) > 3 THEN {CLIP('l.b0 + trunc((l.b0 - g.b0) * 150 / 100.0)')} ELSE l.b0 END AS b0 FROM l JOIN bx5 g USING (image_id, x, y)"))

# --- reductions ---------------------------------------------------------------------------------------

_LONG = "v AS (SELECT image_id, CAST(k AS INTEGER) AS band, [b0, b1, b2][k + 1] AS v FROM rgb, range(3) AS t(k))"
query("op_histogram", "rgb", A.histogram, f", {_LONG} SELECT image_id, band, v, count(*) AS n FROM v GROUP BY ALL")
query("op_histogram_zeros", "l", lambda a: A.histogram(a, zeros=True), ", i AS (SELECT DISTINCT image_id FROM l) SELECT i.image_id, 0 AS band, CAST(k AS INTEGER) AS v, count(l.b0) AS n FROM i CROSS JOIN range(256) AS t(k) LEFT JOIN l ON l.image_id = i.image_id AND l.b0 = k GROUP BY ALL")
query("op_histogram_mask", "rgb l2", lambda a, m: A.histogram(a, P.posterize(m, 1)), ", v AS (SELECT a.image_id, CAST(k AS INTEGER) AS band, [a.b0, a.b1, a.b2][k + 1] AS v FROM rgb a JOIN l2 m USING (image_id, x, y), range(3) AS t(k) WHERE m.b0 & 128 <> 0) SELECT image_id, band, v, count(*) AS n FROM v GROUP BY ALL")
query("op_histogram_f", "f", A.histogram_scaled, ", e AS (SELECT image_id, min(b0) AS lo, max(b0) AS hi FROM f GROUP BY image_id) SELECT image_id, CAST(least(255, floor((b0 - lo) * 255.0::DOUBLE / (hi - lo))) AS INTEGER) AS v, count(*) AS n FROM f JOIN e USING (image_id) WHERE lo < hi GROUP BY ALL")
_STAT = """count(*) AS "count", CAST(sum(v) AS BIGINT) AS "sum", CAST(sum(v * v) AS BIGINT) AS sum2, CAST(list_sort(list(v))[count(*) // 2 + 1] AS INTEGER) AS median, min(v) AS lo, max(v) AS hi,
    sum(v) / CAST(count(*) AS DOUBLE) AS mean, sqrt(sum(v * v) / CAST(count(*) AS DOUBLE)) AS rms, (sum(v * v) - sum(v) * sum(v) / CAST(count(*) AS DOUBLE)) / count(*) AS var, sqrt((sum(v * v) - sum(v) * sum(v) / CAST(count(*) AS DOUBLE)) / count(*)) AS stddev"""
_R4 = lambda df: df.withColumns({c: F.round(c, 4) for c in ("mean", "rms", "var", "stddev")})
_ROUNDED = 'SELECT image_id, band, "count", "sum", sum2, median, lo, hi, round(mean, 4) AS mean, round(rms, 4) AS rms, round(var, 4) AS var, round(stddev, 4) AS stddev FROM st'
query("op_stat", "rgb", lambda a: _R4(A.statistics(a)), f", {_LONG}, st AS (SELECT image_id, band, {_STAT} FROM v GROUP BY image_id, band) {_ROUNDED}")
query("op_stat_mask", "rgb l2", lambda a, m: _R4(A.statistics(a, P.posterize(m, 1))), f", v AS (SELECT a.image_id, CAST(k AS INTEGER) AS band, [a.b0, a.b1, a.b2][k + 1] AS v FROM rgb a JOIN l2 m USING (image_id, x, y), range(3) AS t(k) WHERE m.b0 & 128 <> 0), st AS (SELECT image_id, band, {_STAT} FROM v GROUP BY image_id, band) {_ROUNDED}")
query("op_extrema", "rgb", A.extrema, f", {_LONG} SELECT image_id, band, min(v) AS lo, max(v) AS hi FROM v GROUP BY ALL")
query("op_getbbox", "l", lambda a: A.bounding_box(P.solarize(P.posterize(a, 1), 256)), 'SELECT image_id, min(x) AS "left", min(y) AS upper, max(x) + 1 AS "right", max(y) + 1 AS lower FROM l WHERE b0 >= 128 GROUP BY image_id')
query("op_getbbox_sparse", "sparse", A.bounding_box, 'SELECT image_id, min(x) AS "left", min(y) AS upper, max(x) + 1 AS "right", max(y) + 1 AS lower FROM sparse GROUP BY image_id')
query("op_getprojection", "l", lambda a: A.projection(P.posterize(a, 1)), """SELECT image_id, 'x' AS axis, x AS "at", CAST(max(b0 >= 128) AS INTEGER) AS "any" FROM l GROUP BY image_id, x UNION ALL SELECT image_id, 'y', y, CAST(max(b0 >= 128) AS INTEGER) FROM l GROUP BY image_id, y""")
query("op_getcolors", "rgb", lambda a: A.colors(P.posterize(a, 2), 30), ", c AS (SELECT image_id, b0 & 192 AS b0, b1 & 192 AS b1, b2 & 192 AS b2, count(*) AS n FROM rgb GROUP BY ALL) SELECT image_id, b0, b1, b2, n FROM c QUALIFY count(*) OVER (PARTITION BY image_id) <= 30")
query("op_entropy", "rgb", lambda a: A.entropy(a).withColumn("entropy", F.round("entropy", 6)), f", {_LONG}, c AS (SELECT image_id, band, v, count(*) AS n FROM v GROUP BY ALL) SELECT image_id, round(-sum(n / 192.0::DOUBLE * log2(n / 192.0::DOUBLE)), 6) AS entropy FROM c GROUP BY image_id")
query("op_has_transparency", "rgba", A.has_transparency, "SELECT image_id, min(b3) < 255 AS transparent FROM rgba GROUP BY image_id")

# --- histogram-driven ---------------------------------------------------------------------------------

_AUTO = """, v AS (SELECT image_id, b0 AS v FROM {s}), r AS (SELECT image_id, list_sort(list(v)) AS a, count(*) AS n FROM v GROUP BY image_id),
    e AS (SELECT image_id, a[CAST(least(floor(n * {c} / 100.0), n - 1) AS BIGINT) + 1] AS lo, a[CAST(least(floor(n * (100 - {c}) / 100.0), n - 1) AS BIGINT) + 1] AS hi FROM r)
    SELECT image_id, w, h, x, y, CASE WHEN hi <= lo THEN b0 ELSE CAST(trunc(greatest(0, least(255, b0 * (255.0::DOUBLE / (hi - lo)) + (-lo * (255.0::DOUBLE / (hi - lo)))))) AS INTEGER) END AS b0 FROM {s} JOIN e USING (image_id)"""
query("op_autocontrast", "s", E.autocontrast, _AUTO.format(s="s", c=0))
query("op_autocontrast_cutoff", "l", lambda a: E.autocontrast(a, 10), _AUTO.format(s="l", c=10))
query("op_equalize", "s", E.equalize, """
    , c AS (SELECT image_id, b0 AS v, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY image_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, count(*) OVER (PARTITION BY image_id) AS ks,
        floor((sum(n) OVER (PARTITION BY image_id) - last_value(n) OVER (PARTITION BY image_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 255.0) AS step FROM c)
    SELECT s.image_id, w, h, x, y, CASE WHEN ks <= 1 OR step = 0 THEN b0 ELSE CAST(least(255, floor((floor(step / 2) + before) / step)) AS INTEGER) END AS b0 FROM s JOIN k ON k.image_id = s.image_id AND k.v = s.b0""")

# --- drawing ------------------------------------------------------------------------------------------

query("op_draw_rectangle", "s3", lambda a: D.rectangle(a, (4, 6, 20, 15), (1, 2, 3), (200, 201, 202), 2),
      _some([f"CASE WHEN x BETWEEN 4 AND 20 AND y BETWEEN 6 AND 15 THEN CASE WHEN x BETWEEN 6 AND 18 AND y BETWEEN 8 AND 13 THEN {k + 1} ELSE {200 + k} END ELSE b{k} END" for k in range(3)], "s3"))
query("op_draw_point", "s", lambda a: D.points(a, [(1, 2), (30, 31), (40, 2)], [255]), _some(["CASE WHEN (x = 1 AND y = 2) OR (x = 30 AND y = 31) THEN 255 ELSE b0 END"], "s"))
query("op_draw_line", "s", lambda a: D.line(a, [(2, 3), (18, 19), (30, 19)], [255]), _some(["CASE WHEN (y - x = 1 AND x BETWEEN 2 AND 18) OR (y = 19 AND x BETWEEN 18 AND 30) THEN 255 ELSE b0 END"], "s"))
query("op_draw_bitmap", "s l", lambda a, m: D.bitmap(a, (3, 3), m, [250]), f"SELECT s.image_id, s.w, s.h, s.x, s.y, {_MIX('250', 's.b0', 'coalesce(m.b0, 0)')} AS b0 FROM s LEFT JOIN l m ON m.image_id = s.image_id AND s.x = m.x + 3 AND s.y = m.y + 3")


def _walked(name: str, a: int, b: int) -> str:
    """CTE ``name`` (y, r, l): the rows of a quarter of an ellipse walked from its side, (a, b % 2), to its top."""
    off = lambda x, y: f"abs({a * a} * ({y}) * ({y}) + {b * b} * ({x}) * ({x}) - {a * a * b * b})"
    return f"""{name}_walk(x, y) AS (SELECT CAST({a} AS BIGINT), CAST({b % 2} AS BIGINT) UNION ALL
        SELECT CASE WHEN x <= 1 OR up <= least(aslant, inwards) THEN x ELSE x - 2 END, CASE WHEN x > 1 AND inwards < least(up, aslant) THEN y ELSE y + 2 END
        FROM (SELECT x, y, {off('x', 'y + 2')} AS up, {off('x - 2', 'y + 2')} AS aslant, {off('x - 2', 'y')} AS inwards FROM {name}_walk WHERE x <> {a % 2} OR y <> {b})),
        {name} AS (SELECT y, max(x) AS r, min(x) AS l FROM {name}_walk GROUP BY y)"""


def _ring(name: str, box: tuple[int, int, int, int], width: int) -> str:
    """CTE ``name`` (id, y, p, q): spans of the outer pixels of an ellipse, in half pixels from its middle."""
    a, b, inset = box[2] - box[0], box[3] - box[1], 2 * (width - 1)
    inner = min(a, b) >= inset
    start = f"{_walked(f'{name}o', a, b)}, {_walked(f'{name}i', a - inset, b - inset) if inner else f'{name}i AS (SELECT 0 AS y, 0 AS l WHERE false)'}"
    return f"""{start}, {name}s AS (SELECT o.y, o.r, coalesce(i.l, {a % 2}) AS l FROM {name}o o LEFT JOIN {name}i i USING (y)),
        {name} AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT y * f AS y, CASE WHEN side = 0 THEN -r WHEN l = 0 THEN 2 ELSE l END AS p, CASE WHEN side = 0 THEN -l ELSE r END AS q
                   FROM {name}s, (VALUES (-1), (1)) AS t(f), range(2) AS v(side) WHERE side = 0 OR l > 0 OR l < r))"""


def _kept(spans: str, region: tuple) -> str:
    """SQL of what a region leaves of spans: ("half", a, b, c), ("and", region, region) or ("or", region, region)."""
    kind, *parts = region
    if kind == "or":
        return f"({_kept(spans, parts[0])} UNION ALL {_kept(spans, parts[1])})"
    if kind == "and":
        return f"(SELECT l.id, l.y, greatest(l.p, r.p) AS p, least(l.q, r.q) AS q FROM {_kept(spans, parts[0])} l JOIN {_kept(spans, parts[1])} r USING (id) WHERE greatest(l.p, r.p) <= least(l.q, r.q))"
    a, b, c = (f"CAST({v!r} AS DOUBLE)" for v in map(float, parts))
    if abs(parts[0]) < 1e-9:
        return f"(SELECT id, y, p, q FROM {spans} WHERE {b} * y + {c} >= -1e-9)"
    cut = lambda v, f: f"CASE WHEN {a} * {v} + ({b} * y + {c}) < 1e-9 THEN round({f}({v}, -({b} * y + {c}) / {a})) ELSE {v} END"
    return f"(SELECT * FROM (SELECT id, y, {cut('p', 'greatest')} AS p, {cut('q', 'least')} AS q FROM {spans}) WHERE p <= q)"


def _cover(name: str, spans: str, box: tuple[int, int, int, int], size: int = 32) -> str:
    """CTE ``name`` (x, y): the pixels under half-pixel spans."""
    a, b = box[2] - box[0], box[3] - box[1]
    place = lambda v, at, d: f"{at} + CAST({v} + {d} AS BIGINT) // 2"
    return f"{name} AS (SELECT DISTINCT u AS x, {place('y', box[1], b)} AS y FROM {spans}, range({size}) AS t(u) WHERE u BETWEEN {place('p', box[0], a)} AND {place('q', box[0], a)})"


def _painted(covers: list[tuple[str, int]], source: str = "s") -> str:
    """SQL of one band painted through covers, the first on top."""
    joins = " ".join(f"LEFT JOIN {n} ON {n}.x = {source}.x AND {n}.y = {source}.y" for n, _ in covers)
    cases = " ".join(f"WHEN {n}.x IS NOT NULL THEN {v}" for n, v in covers)
    return f" SELECT {', '.join(f'{source}.{c.strip()}' for c in PLACE.split(','))}, CAST(CASE {cases} ELSE b0 END AS INTEGER) AS b0 FROM {source} {joins}"


def _filled(name: str, xy: list[tuple[int, int]], size: int = 32) -> str:
    """CTE ``name`` (x, y): the pixels of a polygon by pairs of crossings, in single precision."""
    sides = ", ".join(f"({k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for k, (a, b) in enumerate(zip(xy, [*xy[1:], xy[0]], strict=True)) if a != b)
    at = lambda e, y: f"(CAST({y} - {e}.ay AS FLOAT) * {e}.slope + CAST({e}.ax AS FLOAT))"
    to = f"CASE WHEN r.y = e.hi THEN r.y - 1 ELSE r.y + 1 END"
    ends = lambda e: f"(r.y IN ({e}.lo, {e}.hi) AND {e}.slope <> 0)"
    mine, other, near, far = at("e", "r.y"), at("o", "r.y"), at("e", f"({to})"), at("o", f"({to})")
    one = "CAST(1 AS FLOAT)"
    return f"""{name}v(k, ax, ay, tx, ty) AS (VALUES {sides}),
        {name}e AS (SELECT *, least(ay, ty) AS lo, greatest(ay, ty) AS hi, CAST(tx - ax AS FLOAT) / CAST(ty - ay AS FLOAT) AS slope FROM {name}v WHERE ay <> ty),
        {name}n AS (SELECT least(max(greatest(ay, ty)), {size - 1}) AS last FROM {name}v),
        {name}m AS (SELECT r.y, e.k, any_value({mine}) AS x, any_value(r.y = e.hi AND r.y < last) AS twice, any_value({ends('e')}) AS ends,
              arg_min(CASE WHEN {mine} > {near} + {one} AND {mine} > {far} + {one} THEN round(greatest({near}, {far})) + {one}
                           WHEN {mine} < {near} - {one} AND {mine} < {far} - {one} THEN round(least({near}, {far})) - {one} ELSE {mine} END, o.k) AS turned
              FROM {name}e e JOIN range({size}) AS r(y) ON r.y BETWEEN e.lo AND e.hi CROSS JOIN {name}n
              LEFT JOIN {name}e o ON o.k < e.k AND {ends('o')} AND round({mine}) = round({other}) AND {to} BETWEEN o.lo AND o.hi GROUP BY r.y, e.k),
        {name}x AS (SELECT y, x FROM {name}m, range(2) WHERE twice UNION ALL SELECT y, CASE WHEN ends THEN coalesce(turned, x) ELSE x END FROM {name}m WHERE NOT twice),
        {name}p AS (SELECT y, CAST(x AS DOUBLE) AS p, CAST(lead(x) OVER w AS DOUBLE) AS q, row_number() OVER w AS i FROM {name}x WINDOW w AS (PARTITION BY y ORDER BY x)),
        {name} AS (SELECT DISTINCT u AS x, y FROM (SELECT y, round(p) AS a, sign(q) * ceil(abs(q) - 0.5::DOUBLE) AS b FROM {name}p WHERE i % 2 = 1 AND q IS NOT NULL
                   UNION ALL SELECT ay, least(ax, tx), greatest(ax, tx) FROM {name}v WHERE ay = ty), range({size}) AS t(u) WHERE u BETWEEN a AND b)"""


def _thin(name: str, xy: list[tuple[int, int]]) -> str:
    """CTE ``name`` (x, y): thin lines around a polygon."""
    sides = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(xy, [*xy[1:], xy[0]], strict=True))
    return f"""{name}j(x0, y0, x1, y1) AS (VALUES {sides}),
        {name}d AS (SELECT *, abs(x1 - x0) AS dx, abs(y1 - y0) AS dy, greatest(abs(x1 - x0), abs(y1 - y0)) AS n, least(abs(x1 - x0), abs(y1 - y0)) AS m FROM {name}j),
        {name}k AS (SELECT *, unnest(range(n + 1)) AS k FROM {name}d), {name}q AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE (2 * m * k + n) // (2 * n) END AS v FROM {name}k),
        {name} AS (SELECT DISTINCT CAST(x0 + sign(x1 - x0) * CASE WHEN dy > dx THEN v ELSE k END AS INTEGER) AS x, CAST(y0 + sign(y1 - y0) * CASE WHEN dy > dx THEN k ELSE v END AS INTEGER) AS y FROM {name}q)"""


def _any(name: str, parts: list[str], within: str = "") -> str:
    both = f" SEMI JOIN {within} USING (x, y)" if within else ""
    return f"{name} AS (SELECT DISTINCT x, y FROM ({' UNION ALL '.join(f'SELECT x, y FROM {p}' for p in parts)}){both})"


_OVAL = (4, 6, 27, 21)
query("op_draw_ellipse", "s", lambda a: D.ellipse(a, _OVAL, [255], [9], 3),
      f", {_ring('f', _OVAL, 99)}, {_ring('g', _OVAL, 3)}, {_cover('inside', 'f', _OVAL)}, {_cover('rim', 'g', _OVAL)}" + _painted([("rim", 9), ("inside", 255)]))
_TALL = (5, 2, 24, 30)
query("op_draw_ellipse_tall", "s", lambda a: D.ellipse(a, _TALL, None, [200], 1), f", {_ring('g', _TALL, 1)}, {_cover('rim', 'g', _TALL)}" + _painted([("rim", 200)]))


def _polar(box: tuple[int, int, int, int], angle: float) -> tuple[float, float]:
    return (box[2] - box[0]) * math.cos(math.radians(angle)), (box[3] - box[1]) * math.sin(math.radians(angle))


def _normal(box: tuple[int, int, int, int], angle: float, sign: int) -> tuple:
    """The half-plane on one side of a lying ellipse's normal at an angle."""
    a, b, t = box[2] - box[0], box[3] - box[1], math.radians(angle)
    return "half", -sign * a * math.sin(t), sign * b * math.cos(t), sign * (a * a - b * b) * math.sin(angle * math.pi / 90) / 2


_WIDE = (3, 6, 28, 23)
for _name, _start, _end, _part in (
    ("", 30, 200, ("or", ("and", ("half", 0, 1, 0), _normal(_WIDE, 30, 1)), ("and", ("half", 0, -1, 0), _normal(_WIDE, 200, -1)))),
    ("_quarter", 20, 75, ("and", ("and", _normal(_WIDE, 20, 1), _normal(_WIDE, 75, -1)), ("half", 0, 1, 0))),
    ("_most", 150, 490, ("or", ("or", _normal(_WIDE, 150, 1), _normal(_WIDE, 490, -1)), ("half", 0, -1, 0))),
    ("_half", 180, 270, ("and", _normal(_WIDE, 180, 1), _normal(_WIDE, 270, -1))),
):
    query(f"op_draw_arc{_name}", "s", lambda a, s=_start, e=_end: D.arc(a, _WIDE, s, e, [255], 3), f", {_ring('g', _WIDE, 3)}, {_cover('rim', _kept('g', _part), _WIDE)}" + _painted([("rim", 255)]))
_XA, _YA, _XB, _YB = *_polar(_WIDE, 30), *_polar(_WIDE, 200)
_LINE = ("half", _YB - _YA, _XA - _XB, -((_YB - _YA) * _XA + (_XA - _XB) * _YA))
_STRIP = ("and", _LINE, ("half", -_LINE[1], -_LINE[2], 4 * math.hypot(*_LINE[1:3]) - _LINE[3]))
query("op_draw_chord", "s", lambda a: D.chord(a, _WIDE, 30, 200, [255], [0], 2),
      f", {_ring('f', _WIDE, 99)}, {_ring('g', _WIDE, 2)}, {_cover('inside', _kept('f', _LINE), _WIDE)}, {_cover('line', _kept('f', _STRIP), _WIDE)}, {_cover('rim', _kept('g', _LINE), _WIDE)}"
      + _painted([("line", 0), ("rim", 0), ("inside", 255)]))
_SLICE = ("and", ("half", -_YA, _XA, 0), ("half", _YB, -_XB, 0))
_STROKE = lambda x, y: ("and", ("and", ("half", -y, x, 2 * math.hypot(x, y)), ("half", y, -x, 2 * math.hypot(x, y))), ("half", x, y, 0))
_HUB = (15, 14, 16, 15)  # (3 + 28 - 2) / 2 and (6 + 23 - 2) / 2, halves up
query("op_draw_pieslice", "s", lambda a: D.pieslice(a, _WIDE, 30, 200, [255], [0], 2),
      f", {_ring('f', _WIDE, 99)}, {_ring('g', _WIDE, 2)}, {_ring('h', _HUB, 2)}, {_cover('inside', _kept('f', _SLICE), _WIDE)}, {_cover('first', _kept('f', _STROKE(_XA, _YA)), _WIDE)}, "
      f"{_cover('second', _kept('f', _STROKE(_XB, _YB)), _WIDE)}, {_cover('rim', _kept('g', _SLICE), _WIDE)}, {_cover('hub', 'h', _HUB)}" + _painted([("first", 0), ("second", 0), ("rim", 0), ("hub", 0), ("inside", 255)]))


def _corners(width: int | None) -> tuple[str, list[str]]:
    """Quarters of ellipses of 12 pixels in the corners of (3, 4, 28, 24), or of their rims."""
    squares = [((3, 4, 15, 16), (-1, -1)), ((16, 4, 28, 16), (1, -1)), ((16, 12, 28, 24), (1, 1)), ((3, 12, 15, 24), (-1, 1))]
    ctes, name = [], "q" if width is None else "r"
    for k, (box, (sx, sy)) in enumerate(squares):
        quarter = ("and", ("half", sx, 0, 0), ("half", 0, sy, 0))
        ctes += [_ring(f"{name}{k}", box, 24 if width is None else width), _cover(f"{name}{k}c", _kept(f"{name}{k}", quarter), box)]
    return ", ".join(ctes), [f"{name}{k}c" for k in range(4)]


_ROUND, _RIMS = _corners(None), _corners(2)
_BARS = lambda name, boxes: f"{name} AS (SELECT DISTINCT x, y FROM (VALUES {', '.join(map(str, boxes))}) AS t(a, b, c, d), range(32) AS p(x), range(32) AS r(y) WHERE x BETWEEN a AND c AND y BETWEEN b AND d)"
query("op_draw_rounded_rectangle", "s", lambda a: D.rounded_rectangle(a, (3, 4, 28, 24), 6, [255], [0], 2),
      f", {_ROUND[0]}, {_RIMS[0]}, {_BARS('bars', [(10, 4, 21, 24), (3, 11, 9, 17), (22, 11, 28, 17)])}, {_BARS('edges', [(10, 4, 21, 5), (10, 23, 21, 24), (3, 11, 4, 17), (27, 11, 28, 17)])}, "
      f"{_any('inside', [*_ROUND[1], 'bars'])}, {_any('rim', [*_RIMS[1], 'edges'])}" + _painted([("rim", 0), ("inside", 255)]))

_CONCAVE = [(3, 4), (15, 9), (28, 3), (22, 16), (27, 28), (14, 21), (14, 27), (4, 27), (9, 15)]
query("op_draw_polygon", "s", lambda a: D.polygon(a, _CONCAVE, [255], [7]), f", {_filled('inside', _CONCAVE)}, {_thin('rim', _CONCAVE)}" + _painted([("rim", 7), ("inside", 255)]))
_STAR = [(16, 1), (25, 30), (2, 11), (30, 12), (6, 29)]
query("op_draw_polygon_crossing", "s", lambda a: D.polygon(a, _STAR, [255]), f", {_filled('inside', _STAR)}" + _painted([("inside", 255)]))
_DEEP = [(2, 8), (30, 2), (21, 31), (26, 45), (9, 31), (12, 20)]
query("op_draw_polygon_beyond", "s", lambda a: D.polygon(a, _DEEP, [255]), f", {_filled('inside', _DEEP)}" + _painted([("inside", 255)]))
_FLAT = [(1, 20), (30, 14), (4, 22), (29, 29), (2, 29)]
_SIDES = [_filled(f"t{k}", SH.wide_line(p, q, 5)) for k, (p, q) in enumerate(zip(_CONCAVE, [*_CONCAVE[1:], _CONCAVE[0]], strict=True))]
query("op_draw_polygon_wide", "s", lambda a: D.polygon(a, _CONCAVE, [255], [7], 3),
      f", {_filled('inside', _CONCAVE)}, {', '.join(_SIDES)}, {_any('rim', [f't{k}' for k in range(len(_SIDES))], 'inside')}" + _painted([("rim", 7), ("inside", 255)]))
query("op_draw_polygon_spikes", "s", lambda a: D.polygon(a, _FLAT, [255]), f", {_filled('inside', _FLAT)}" + _painted([("inside", 255)]))
query("op_draw_line_wide", "s", lambda a: D.line(a, [(3, 5), (28, 17), (9, 28)], [255], 4),
      f", {_filled('first', SH.wide_line((3, 5), (28, 17), 4))}, {_filled('second', SH.wide_line((28, 17), (9, 28), 4))}" + _painted([("first", 255), ("second", 255)]))
_SIX = [(int(round(16 + 10 * math.cos(math.radians(105 + 60 * k)), 2)), int(round(16 + 10 * math.sin(math.radians(105 + 60 * k)), 2))) for k in range(6)]  # 30 + 90 - 15 degrees for the first
query("op_draw_regular_polygon", "s", lambda a: D.regular_polygon(a, (16, 16), 10, 6, 15, fill=[255], outline=[0]), f", {_filled('inside', _SIX)}, {_thin('rim', _SIX)}" + _painted([("rim", 0), ("inside", 255)]))

# --- generators, bytes, serial operators --------------------------------------------------------------

QUERIES["op_linear_gradient"] = lambda spark, _: X.linear_gradient(spark)
ORACLE_SQL["op_linear_gradient"] = "SELECT CAST(0 AS BIGINT) AS image_id, 256 AS w, 256 AS h, CAST(a.i AS INTEGER) AS x, CAST(b.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS b0 FROM range(256) AS a(i), range(256) AS b(i)"
for _m, _v in (("1", "CASE WHEN {} > 0 THEN 255 ELSE 0 END"), ("I", "{}"), ("F", "CAST({} AS FLOAT)")):
    QUERIES[f"op_linear_gradient_{_m.lower()}"] = lambda spark, _, m=_m: X.linear_gradient(spark, m)
    ORACLE_SQL[f"op_linear_gradient_{_m.lower()}"] = f"SELECT CAST(0 AS BIGINT) AS image_id, 256 AS w, 256 AS h, CAST(a.i AS INTEGER) AS x, CAST(b.i AS INTEGER) AS y, {_v.format('CAST(b.i AS INTEGER)')} AS b0 FROM range(256) a(i), range(256) b(i)"
query("op_reduce_box", "s", lambda a: G.reduce(a, 4, 2, (4, 6, 20, 26)),
      "SELECT image_id, 4 AS w, 10 AS h, CAST((x - 4) // 4 AS INTEGER) AS x, CAST((y - 6) // 2 AS INTEGER) AS y, CAST((sum(b0) + 4) // 8 AS INTEGER) AS b0 FROM s WHERE x BETWEEN 4 AND 19 AND y BETWEEN 6 AND 25 GROUP BY ALL")
query("op_apply_transparency", "l", lambda a: C.apply_transparency(C.put_palette(a.select("image_id").distinct(), _PAL), (9, 200)).select("image_id", "idx", "a"),
      ", i AS (SELECT DISTINCT image_id FROM l) SELECT image_id, CAST(k AS INTEGER) AS idx, a FROM i, (VALUES " + ", ".join(f"({k}, {(9, 200)[k] if k < 2 else 255})" for k in range(len(_PAL))) + ") AS t(k, a)")
QUERIES["op_radial_gradient"] = lambda spark, _: X.radial_gradient(spark)
ORACLE_SQL["op_radial_gradient"] = "SELECT CAST(0 AS BIGINT) AS image_id, 256 AS w, 256 AS h, CAST(a.i AS INTEGER) AS x, CAST(b.i AS INTEGER) AS y, CAST(least(255, floor(sqrt(((a.i - 128) * (a.i - 128) + (b.i - 128) * (b.i - 128)) * 2.0::DOUBLE))) AS INTEGER) AS b0 FROM range(256) AS a(i), range(256) AS b(i)"
QUERIES["op_mandelbrot"] = lambda spark, _: X.mandelbrot(spark, (48, 32), (-2.25, -1.5, 1.5, 1.5), 30)
ORACLE_SQL["op_mandelbrot"] = """WITH RECURSIVE g AS (SELECT CAST(a.i AS INTEGER) AS x, CAST(b.i AS INTEGER) AS y, -2.25::DOUBLE + a.i * (3.75::DOUBLE / 47) AS cr, -1.5::DOUBLE + b.i * (3.0::DOUBLE / 31) AS ci FROM range(48) AS a(i), range(32) AS b(i)),
    z AS (SELECT x, y, cr, ci, 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM g UNION ALL
          SELECT x, y, cr, ci, k + 1, a * a - b * b + cr, a * b * 2.0::DOUBLE + ci FROM z WHERE k < 30 AND a * a + b * b <= 100)
    SELECT CAST(0 AS BIGINT) AS image_id, 48 AS w, 32 AS h, x, y, CAST(coalesce(min(CASE WHEN a * a + b * b > 100 THEN k END), 0) * 255 // 30 AS INTEGER) AS b0 FROM z GROUP BY x, y"""
query("op_new", "l", lambda a: X.constant(a.select("image_id").distinct(), (4, 3), (1, 2, 3)), "SELECT DISTINCT image_id, 4 AS w, 3 AS h, x, y, 1 AS b0, 2 AS b1, 3 AS b2 FROM l WHERE x < 4 AND y < 3")
query("op_tobytes", "rgb", lambda a: X.to_bytes(a, "RGB", "BGR").select("image_id", F.sha2("data", 256).alias("sha")),
      ", o AS (SELECT image_id, string_agg(printf('%02X%02X%02X', b2, b1, b0), '' ORDER BY y, x) AS d FROM rgb GROUP BY image_id) SELECT image_id, sha256(unhex(d)) AS sha FROM o")
query("op_frombytes", "rgb", lambda a: X.from_bytes(X.to_bytes(a, "RGB").select("image_id", "data"), "data", "RGB", (8, 8)), f"SELECT {PLACE}, b0, b1, b2 FROM rgb")
query("op_tobitmap", "l", lambda a: X.to_bitmap(P.posterize(a, 1)), """, r AS (SELECT image_id, y, '0x' || lower(lpad(printf('%X', CAST(sum(CASE WHEN b0 >= 128 THEN 1 << x ELSE 0 END) AS INTEGER)), 2, '0')) AS v FROM l GROUP BY image_id, y)
    SELECT image_id, '#define image_width 8' || chr(10) || '#define image_height 8' || chr(10) || 'static char image_bits[] = {' || chr(10) || string_agg(v, ',' ORDER BY y) || chr(10) || '};' AS source FROM r GROUP BY image_id""")
query("op_fromarray", "f", lambda a: a, f"SELECT {PLACE}, b0 FROM f")
query("op_dither", "l", R.dither)
query("op_effect_noise", "l", lambda a: R.effect_noise(a.select("image_id", "w", "h").distinct(), 20.0))
query("op_effect_spread", "l", lambda a: R.effect_spread(a, 3), """, d_walk(k, v) AS (SELECT 0, 16807::BIGINT UNION ALL SELECT k + 1, v * 16807 % 2147483647 FROM d_walk WHERE k < 127),
    st AS (SELECT a.k // 2 AS i, a.v % 4 - 1 AS dx, b.v % 4 - 1 AS dy FROM d_walk a JOIN d_walk b ON b.k = a.k + 1 WHERE a.k % 2 = 0),
    m AS (SELECT image_id, x, y, i, x + dx AS px, y + dy AS py, b0 FROM l JOIN st ON i = y * 8 + x),
    p AS (SELECT m.*, s.b0 AS c0 FROM m JOIN l s ON s.image_id = m.image_id AND s.x = px AND s.y = py),
    wr AS (SELECT image_id, x, y, -1 AS t, b0 FROM l UNION ALL SELECT image_id, x, y, i, c0 FROM p UNION ALL SELECT image_id, px, py, i, b0 FROM p)
    SELECT image_id, 8 AS w, 8 AS h, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, arg_max(b0, t) AS b0 FROM wr GROUP BY image_id, wr.x, wr.y""")
for _n, _m in (("median_cut", 0), ("max_coverage", 1), ("octree", 2)):
    query(f"op_quantize_{_n}", "rgb" if _m < 2 else "rgba", lambda a, m=_m: R.quantize(a, 16, m, 1)[0])
query("op_quantize_palette", "rgb", lambda a: R.quantize_to(a, _FEW))


# --- files, colour strings, chains --------------------------------------------------------------------

query("op_png_round_trip", "rgb", lambda a: FL.load_pixels(FL.describe(FL.encode(a, "PNG").select("image_id", "content")), "RGB"), f"SELECT {PLACE}, b0, b1, b2 FROM rgb")
query("op_bmp_round_trip", "rgba", lambda a: FL.load_pixels(FL.describe(FL.encode(a, "BMP").select("image_id", "content")), "RGBA"), f"SELECT {PLACE}, b0, b1, b2, b3 FROM rgba")
query("op_open_header", "l", lambda a: FL.verify(FL.describe(FL.encode(a, "PNG").select("image_id", "content"))).select("image_id", "format", "width", "height", "ok"),
      "SELECT DISTINCT image_id, 'PNG' AS format, 8 AS width, 8 AS height, true AS ok FROM l")
query("op_chain", "rgb", lambda a: Chain(a, "RGB").invert().solarize(100).posterize(3).flip().mirror().transpose("TRANSPOSE").frame(),
      "SELECT image_id, h AS w, w AS h, 7 - y AS x, 7 - x AS y, " + ", ".join(f"(CASE WHEN 255 - b{k} >= 100 THEN b{k} ELSE 255 - b{k} END) & 224 AS b{k}" for k in range(3)) + " FROM rgb")
query("op_getrgb", "l", lambda a: a.select("image_id").distinct().select("image_id", getrgb(F.format_string("rgb(%d, %d%s)", F.col("image_id"), F.col("image_id") % 256, F.lit(", 7"))).alias("c"), getrgb(F.concat(F.lit("#"), F.lower(F.lpad(F.hex("image_id"), 6, "0")))).alias("d")).select("image_id", "c.r", "c.g", "c.b", F.col("d.g").alias("hex_g"), F.col("d.b").alias("hex_b"), F.col("d.a").alias("hex_a")),
      "SELECT DISTINCT image_id, CAST(image_id AS INTEGER) AS r, CAST(image_id % 256 AS INTEGER) AS g, 7 AS b, CAST(image_id // 256 % 256 AS INTEGER) AS hex_g, CAST(image_id % 256 AS INTEGER) AS hex_b, 255 AS hex_a FROM l")


def _font(spark: SparkSession) -> DataFrame:
    """A made-up font: character c is 5 wide, its set pixels the diagonal from (0, c % 3)."""
    codes = spark.range(48, 58).select(F.col("id").cast("int").alias("code"), F.lit(5).alias("advance"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("gx"))
    return codes.select("code", "advance", "gx", (F.col("gx") + F.col("code") % 3).alias("gy"))


def _text(a: DataFrame) -> DataFrame:
    words = a.select("image_id").distinct().select("image_id", F.col("image_id").cast("string").alias("text"))
    return D.text(a, (2, 3), words, _font(a.sparkSession), [255])


query("op_draw_text", "s", _text, """, c AS (SELECT image_id, i, ascii(CAST(image_id AS VARCHAR)[i]) AS code FROM (SELECT DISTINCT image_id FROM s), range(1, 12) AS t(i) WHERE i <= length(CAST(image_id AS VARCHAR))),
    p AS (SELECT DISTINCT image_id, 2 + (i - 1) * 5 + g AS x, 3 + g + code % 3 AS y FROM c, range(4) AS u(g))
    SELECT s.image_id, w, h, s.x, s.y, CASE WHEN p.x IS NOT NULL THEN 255 ELSE b0 END AS b0 FROM s LEFT JOIN p ON p.image_id = s.image_id AND p.x = s.x AND p.y = s.y""")
QUERIES["op_events_raster"] = lambda spark, d: P.invert(P.posterize(T.events_raster(spark, d).drop("image_id").withColumn("image_id", F.lit(0).cast("bigint")).groupBy("image_id", "w", "h", "x", "y").agg(F.least(F.lit(255), F.sum("b0")).cast("int").alias("b0")), 6))
ORACLE_SQL["op_events_raster"] = "SELECT CAST(0 AS BIGINT) AS image_id, 24 AS w, 32 AS h, CAST(hour(ts) AS INTEGER) AS x, CAST(user_id % 32 AS INTEGER) AS y, 255 - (CAST(least(255, count(*)) AS INTEGER) & 252) AS b0 FROM events GROUP BY ALL"

query("op_stat_of_histogram", "rgb", lambda a: _R4(A.statistics_of_counts(A.histogram(a))), f", {_LONG}, st AS (SELECT image_id, band, {_STAT} FROM v GROUP BY image_id, band) {_ROUNDED}")
query("op_histogram_i", "l", lambda a: A.histogram_scaled(a.withColumn("b0", F.col("b0") * 1000 - 70000)),
      ", e AS (SELECT image_id, min(b0) * 1000 - 70000 AS lo, max(b0) * 1000 - 70000 AS hi FROM l GROUP BY image_id) SELECT image_id, CAST(least(255, floor((b0 * 1000 - 70000 - lo) * 255.0::DOUBLE / (hi - lo))) AS INTEGER) AS v, count(*) AS n FROM l JOIN e USING (image_id) WHERE lo < hi GROUP BY ALL")
query("op_getdata", "rgb", lambda a: X.to_frames(a).select("image_id", F.array_join("samples", " ").alias("data")), ", o AS (SELECT image_id, string_agg(concat_ws(' ', b0, b1, b2), ' ' ORDER BY y, x) AS data FROM rgb GROUP BY image_id) SELECT * FROM o")
query("op_size", "rgb", sizes, "SELECT DISTINCT image_id, w, h FROM rgb")
query("op_duplicate", "rgb", lambda a: a, f"SELECT {PLACE}, b0, b1, b2 FROM rgb")
query("op_seek", "l", lambda a: FL.seek(a, 0), f"SELECT {PLACE}, b0 FROM l")
query("op_getpalette", "l", lambda a: C.get_palette(C.put_palette(a.select("image_id").distinct(), _PAL[:20]), "BGR").select("image_id", F.array_join("palette", " ").alias("palette")),
      ", p AS (SELECT string_agg(concat_ws(' ', k * 7 % 256, k * 5 % 256, k * 3 % 256), ' ' ORDER BY k) AS palette FROM range(20) AS t(k)) SELECT DISTINCT image_id, palette FROM l, p")
query("op_palette_save", "l", lambda a: C.palette_text(C.put_palette(a.select("image_id").distinct(), _PAL)),
      ", p AS (SELECT '# Palette' || chr(10) || '# Mode: RGB' || chr(10) || string_agg(concat_ws(' ', k, CASE WHEN k < 200 THEN k * 3 % 256 ELSE 0 END, CASE WHEN k < 200 THEN k * 5 % 256 ELSE 0 END, CASE WHEN k < 200 THEN k * 7 % 256 ELSE 0 END), chr(10) ORDER BY k) || chr(10) AS text FROM range(256) AS t(k)) SELECT DISTINCT image_id, text FROM l, p")


def _words(a: DataFrame) -> DataFrame:
    return a.select("image_id").distinct().select("image_id", F.col("image_id").cast("string").alias("text"))


_GLYPHS = ", c AS (SELECT image_id, i, ascii(CAST(image_id AS VARCHAR)[i]) AS code FROM (SELECT DISTINCT image_id FROM s), range(1, 12) AS t(i) WHERE i <= length(CAST(image_id AS VARCHAR)))"
query("op_text_length", "s", lambda a: D.text_length(_words(a), _font(a.sparkSession)), _GLYPHS + ' SELECT image_id, 5 * count(*) AS "length" FROM c GROUP BY image_id')
query("op_text_bbox", "s", lambda a: D.text_bbox(_words(a), _font(a.sparkSession)),
      _GLYPHS + ' SELECT image_id, CAST(min((i - 1) * 5) AS INTEGER) AS "left", CAST(min(code % 3) AS INTEGER) AS upper, CAST(max((i - 1) * 5 + 4) AS INTEGER) AS "right", CAST(max(code % 3 + 4) AS INTEGER) AS lower FROM c GROUP BY image_id')
query("op_deform", "l", lambda a: S.transform_mesh(a, (8, 8), [((0, 0, 8, 8), (8, 0, 8, 8, 0, 8, 0, 0))]), "SELECT image_id, w, h, 7 - x AS x, y, b0 FROM l")
query("op_putalpha_level", "l", lambda a: C.put_alpha(a, 77), f"SELECT {PLACE}, b0, 77 AS b1 FROM l")
query("op_convert_rgba", "l", lambda a: C.convert(a, "L", "RGBA"), f"SELECT {PLACE}, b0, b0 AS b1, b0 AS b2, 255 AS b3 FROM l")
query("op_convert_cmyk_l", "rgba", lambda a: C.convert(a, "CMYK", "L"), f", c AS (SELECT image_id, w, h, x, y, {', '.join(f'greatest(0, least(255, 255 - b3 - {MULDIV(f'b{k}', '255 - b3')})) AS b{k}' for k in range(3))} FROM rgba) SELECT {PLACE}, CAST({LUMA} AS INTEGER) AS b0 FROM c")
query("op_convert_rgba_la", "rgba", lambda a: C.convert(a, "RGBA", "LA"), f"SELECT {PLACE}, CAST({LUMA} AS INTEGER) AS b0, b3 AS b1 FROM rgba")
query("op_convert_l_1", "l", lambda a: C.convert(a, "L", "1"), f"SELECT {PLACE}, CASE WHEN b0 >= 128 THEN 255 ELSE 0 END AS b0 FROM l")
query("op_convert_ycbcr_l", "rgb", lambda a: C.convert(a, "YCbCr", "L"), f"SELECT {PLACE}, b0 FROM rgb")
query("op_frombytes_1", "l", lambda a: X.from_bytes(X.to_bytes(C.convert(a, "L", "1"), "1").select("image_id", "data"), "data", "1", (8, 8)), f"SELECT {PLACE}, CASE WHEN b0 >= 128 THEN 255 ELSE 0 END AS b0 FROM l")
query("op_brightness_alpha", "rgba", lambda a: P.brightness(a, 0.7, alpha=True), f"SELECT {PLACE}, {', '.join(CLIP(f'b{k} * CAST(0.7 AS DOUBLE)') + f' AS b{k}' for k in range(3))}, b3 FROM rgba")


# --- bitmap fonts -----------------------------------------------------------------------------------------

_SIGNED = lambda v: (v & 0xFFFF).to_bytes(2, "big")


def font_file(record: Callable[[int], Sequence[int]], info: str = "") -> bytes:
    """A bitmap font's metrics file: a header, lines of information, and ten numbers for each of 256 glyphs."""
    return f"PILfont\n;;;;;;9;\n{info}DATA\n".encode() + b"".join(_SIGNED(v) for c in range(256) for v in record(c))


def _record(c: int) -> list[int]:
    """Glyph c is 3 to 5 wide and 4 to 7 high, stands in a field of 8 by 8 of a strip of 128 by 128, hangs over its advance
    by one, sinks by c % 2 after every third, and reaches over the strip's right edge in its last column."""
    w, h = 3 + c % 3 + 4 * (c % 16 == 15), 4 + c % 4
    left, top = c % 16 * 8, c // 16 * 8
    return [w - 1 - 4 * (c % 16 == 15), (c % 3 == 0) * (c % 2), -1, -h, w - 1, 0, left, top, left + w, top + h]


def _font_of(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    font = spark.createDataFrame([(0, bytearray(font_file(_record)))], "font_id int, content binary")
    x, y = F.col("x"), F.col("y")
    strip = spark.range(128 * 128).select(F.lit(0).alias("image_id"), F.lit(128).alias("w"), F.lit(128).alias("h"), (F.col("id") % 128).cast("int").alias("x"), F.floor(F.col("id") / 128).cast("int").alias("y"))
    strip = strip.withColumn("b0", F.when((x * 5 + y * 3) % 4 == 0, 0).otherwise((x * 37 + y * 91) % 256).cast("int"))
    glyphs = FO.font_glyphs(font, strip)
    return glyphs, FO.font_strokes(glyphs, strip)


def _word(a: DataFrame, multiline: bool = False) -> DataFrame:
    """Each image's key, a slash and a number, in one line or in three, the middle one empty."""
    key = F.col("image_id").cast("string")
    end = (F.col("image_id") * 7 % 1000).cast("string")
    return a.select("image_id").distinct().select("image_id", F.lit(0).alias("font_id"), F.concat(key, F.lit("\n\n/" if multiline else "/"), end).alias("text"))


def _with_font(fn: Callable[..., DataFrame], multiline: bool = False) -> Callable[[DataFrame], DataFrame]:
    return lambda a: fn(a, _word(a, multiline), *_font_of(a.sparkSession))


_GLYPH_SQL = """fg AS (SELECT c AS code, w - 1 - 4 * o AS dx, CASE WHEN c % 6 = 3 THEN 1 ELSE 0 END AS dy, h, c % 16 * 8 AS sx, c // 16 * 8 AS sy, least(w, 128 - c % 16 * 8) AS cut
              FROM (SELECT c, CASE WHEN c % 16 = 15 THEN 1 ELSE 0 END AS o, 3 + c % 3 + CASE WHEN c % 16 = 15 THEN 4 ELSE 0 END AS w, 4 + c % 4 AS h FROM range(256) AS t(c)))"""


def _lines_sql(multiline: bool, share: float = 0.0, across: float = 0.0, down: float = 0.0, spacing: int = 4) -> str:
    """CTEs ln (lines with their place) and ch (characters with their pen)."""
    break_ = "chr(10) || chr(10) || '/'" if multiline else "'/'"
    return f""", {_GLYPH_SQL},
        tx AS (SELECT DISTINCT image_id, image_id || {break_} || (image_id * 7 % 1000) AS t FROM s),
        li AS (SELECT image_id, k - 1 AS line, string_split(t, chr(10))[k] AS t FROM tx, range(1, 4) AS r(k) WHERE k <= len(string_split(t, chr(10)))),
        ca AS (SELECT image_id, line, i, ascii(t[i]) AS code FROM li, range(1, 20) AS r(i) WHERE i <= length(t)),
        cp AS (SELECT ca.*, dx, h, sx, sy, cut, coalesce(sum(dx) OVER w, 0) AS pen, 7 + coalesce(sum(dy) OVER w, 0) AS base FROM ca JOIN fg USING (code) WINDOW w AS (PARTITION BY image_id, line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        lw AS (SELECT li.image_id, li.line, li.t, coalesce(sum(dx), 0) AS width FROM li LEFT JOIN cp USING (image_id, line) GROUP BY ALL),
        lt AS (SELECT *, coalesce(sum(CASE WHEN t = '' THEN 10 ELSE 7 END + {spacing}) OVER (PARTITION BY image_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top, max(width) OVER (PARTITION BY image_id) AS widest FROM lw),
        ln AS (SELECT image_id, line, t, width, floor((widest - width) * {share}::DOUBLE) - floor(widest * {across}::DOUBLE) AS l,
                      top - floor(max(CASE WHEN t = '' THEN 0 ELSE top + 7 END) OVER (PARTITION BY image_id) * {down}::DOUBLE) AS top FROM lt),
        st AS (SELECT image_id, line, i, pen - 1 + gx AS x, base - h + gy AS y, CASE WHEN ((sx + gx) * 5 + (sy + gy) * 3) % 4 = 0 THEN 0 ELSE ((sx + gx) * 37 + (sy + gy) * 91) % 256 END AS v
               FROM cp, range(9) AS p(gx), range(7) AS r(gy) WHERE gx < cut AND gy < h),
        px AS (SELECT image_id, l + x AS x, top + y AS y, arg_max(v, line * 100 + i) AS v FROM st JOIN ln USING (image_id, line) WHERE x >= 0 AND x < width AND y >= 0 AND y < 7 GROUP BY ALL)"""


def _inked(at: tuple[int, int], level: str = "px") -> str:
    mixed = "(v * 250 + b0 * (255 - v) + 127) // 255"
    return f" SELECT s.image_id, s.w, s.h, s.x, s.y, CAST(CASE WHEN coalesce(v, 0) = 0 THEN b0 ELSE {mixed} END AS INTEGER) AS b0 FROM s LEFT JOIN {level} p ON p.image_id = s.image_id AND p.x + {at[0]} = s.x AND p.y + {at[1]} = s.y"


_BOX_SQL = ' SELECT image_id, CAST(min(l) AS INTEGER) AS "left", CAST(min(top) AS INTEGER) AS upper, CAST(max(l + width) AS INTEGER) AS "right", CAST(max(top) + 7 AS INTEGER) AS lower FROM ln WHERE t <> \'\' GROUP BY image_id'
query("op_font_glyphs", "s", lambda a: _font_of(a.sparkSession)[0].join(F.broadcast(a.groupBy((F.col("image_id") % 256).cast("int").alias("code")).agg(F.count_distinct("image_id").alias("n"))), "code").select("code", "dx", "dy", "x0", "y0", "x1", "y1", "sx0", "sy0", "sx1", "sy1", "height", "baseline", "n"),
      f", {_GLYPH_SQL}, u AS (SELECT image_id % 256 AS code, count(DISTINCT image_id) AS n FROM s GROUP BY 1) SELECT code, dx, dy, -1 AS x0, -h AS y0, cut - 1 AS x1, 0 AS y1, sx AS sx0, sy AS sy0, sx + cut AS sx1, sy + h AS sy1, 7 AS height, 7 AS baseline, n FROM fg JOIN u USING (code)")
query("op_font_mask", "s", _with_font(lambda a, words, *font: FO.text_mask(words, *font)),
      _lines_sql(False) + " SELECT ln.image_id, CAST(width AS INTEGER) AS w, 7 AS h, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, CAST(coalesce(v, 0) AS INTEGER) AS b0 FROM ln JOIN range(99) AS a(gx) ON gx < width CROSS JOIN range(7) AS b(gy) LEFT JOIN px ON px.image_id = ln.image_id AND px.x = gx AND px.y = gy")
query("op_font_text", "s", _with_font(lambda a, words, *font: FO.draw_text(a, (3, 5), words, *font, [250])), _lines_sql(False) + _inked((3, 5)))
query("op_transposed_text", "s", _with_font(lambda a, words, *font: FO.draw_text(a, (9, 4), words, *font, [250], "ROTATE_90")),
      _lines_sql(False) + ", tp AS (SELECT image_id, px.y AS x, width - 1 - px.x AS y, v FROM px JOIN ln USING (image_id))" + _inked((9, 4), "tp"))
query("op_transposed_bbox", "s", _with_font(lambda a, words, glyphs, _: FO.text_size(words, glyphs, "ROTATE_270")),
      _lines_sql(False) + ' SELECT image_id, 0 AS "left", 0 AS upper, 7 AS "right", CAST(width AS INTEGER) AS lower FROM ln')
query("op_font_length", "s", _with_font(lambda a, words, glyphs, _: FO.text_advance(words, glyphs, "ROTATE_180")), _lines_sql(False) + ' SELECT image_id, CAST(width AS INTEGER) AS "length" FROM ln')
query("op_multiline_text", "s", _with_font(lambda a, words, *font: FO.draw_multiline(a, (14, 1), words, *font, [250], 2, "center", "ma"), True), _lines_sql(True, 0.5, 0.5, 0, 2) + _inked((14, 1)))
query("op_multiline_text_right", "s", _with_font(lambda a, words, *font: FO.draw_multiline(a, (30, 30), words, *font, [250], 4, "right", "rd"), True), _lines_sql(True, 1.0, 1.0, 1.0) + _inked((30, 30)))
query("op_multiline_bbox", "s", _with_font(lambda a, words, glyphs, _: FO.multiline_box(words, glyphs, 4, "right", "mm"), True), _lines_sql(True, 1.0, 0.5, 0.5) + _BOX_SQL)

# --- metadata ---------------------------------------------------------------------------------------------


def _little(v: Any, size: int) -> Any:
    """A number's hex digits, the low byte first."""
    digits = F.lpad(F.hex(v if not isinstance(v, int) else F.lit(v)), 2 * size, "0")
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))


def _exif_of(a: DataFrame) -> DataFrame:
    """A block for each image: its orientation, a resolution of its id to 7, and a directory of its own with a speed."""
    key = F.col("image_id")
    entry = lambda tag, kind, value: F.concat(_little(tag, 2), _little(kind, 2), _little(1, 4), value)
    short = lambda v: F.concat(_little(v, 2), F.lit("0000"))
    first = F.concat(_little(3, 2), entry(274, 3, short(key % 8 + 1)), entry(282, 5, _little(50, 4)), entry(34665, 4, _little(58, 4)), _little(0, 4))
    block = F.concat(F.lit("49492A00"), _little(8, 4), first, _little(key, 4), _little(7, 4), _little(1, 2), entry(34855, 3, short(key * 100 % 60_000)), _little(0, 4))
    return a.select("image_id").distinct().withColumn("exif", F.unhex(block))


def _exif_rows(a: DataFrame) -> DataFrame:
    rows = MD.exif_entries(_exif_of(a))
    ratio = F.array_join(F.transform("ratio", lambda r: F.concat_ws("/", r["n"], r["d"])), " ")
    return rows.select("image_id", "directory", "tag", "kind", "count", F.coalesce(F.array_join("whole", " "), ratio).alias("value"))


query("op_exif_entries", "l", _exif_rows, """, i AS (SELECT DISTINCT image_id FROM l)
    SELECT image_id, directory, tag, kind, 1::BIGINT AS "count", CASE tag WHEN 274 THEN CAST(image_id % 8 + 1 AS VARCHAR) WHEN 282 THEN image_id || '/7' WHEN 34665 THEN '58' ELSE CAST(image_id * 100 % 60000 AS VARCHAR) END AS "value"
    FROM i, (VALUES ('image', 274, 3), ('image', 282, 5), ('image', 34665, 4), ('exif', 34855, 3)) AS t(directory, tag, kind)""")
query("op_exif_orientation", "l", lambda a: MD.orientation_of(_exif_of(a)), "SELECT DISTINCT image_id, CAST(image_id % 8 + 1 AS INTEGER) AS orientation FROM l")


def _xmp_rows(a: DataFrame) -> DataFrame:
    key = F.col("image_id").cast("string")
    text = F.concat(F.lit("head<x:xmpmeta xmlns:x='adobe:ns:meta/'><rdf:RDF><rdf:Description xmp:Rating=\""), (F.col("image_id") % 6).cast("string"), F.lit('"><dc:subject><rdf:Bag><rdf:li>'), key,
                    F.lit("</rdf:li><rdf:li>a &amp; ö</rdf:li></rdf:Bag></dc:subject></rdf:Description></rdf:RDF></x:xmpmeta>tail"))
    files = a.select("image_id").distinct().select("image_id", F.encode(text, "UTF-8").alias("content"))
    return MD.xmp_properties(MD.xmp(files)).select("image_id", "property", F.array_join("values", "|").alias("value"))


query("op_getxmp", "l", _xmp_rows, ", i AS (SELECT DISTINCT image_id FROM l) SELECT image_id, 'xmp:Rating' AS property, CAST(image_id % 6 AS VARCHAR) AS \"value\" FROM i UNION ALL SELECT image_id, 'dc:subject', image_id || '|a & ö' FROM i")

# --- weighted and four-band cases ----------------------------------------------------------------------------

query("op_reduce_rgba", "rgba", lambda a: G.reduce(a, 3, 2, alpha=True),
      _MULTIPLIED + f", r AS (SELECT image_id, 3 AS w, 4 AS h, x // 3 AS x, y // 2 AS y, {', '.join(f'CAST(((sum(b{k}) + count(*) // 2) * (16777216 // count(*))) >> 24 AS INTEGER) AS b{k}' for k in range(4))} FROM m GROUP BY image_id, x // 3, y // 2) SELECT {PLACE}, {_DIVIDED}, b3 FROM r")
query("op_contrast_cmyk", "rgba", lambda a: P.contrast(a, 1.5, "CMYK"),
      f", c AS (SELECT image_id, {', '.join(f'greatest(0, least(255, 255 - b3 - {MULDIV(f'b{k}', '255 - b3')})) AS b{k}' for k in range(3))} FROM rgba), m AS (SELECT image_id, CAST(floor(sum(CAST({LUMA} AS INTEGER)) / count(*) + 0.5) AS INTEGER) AS mean FROM c GROUP BY image_id) "
      f"SELECT image_id, w, h, x, y, {', '.join(CLIP(f'{low} * CAST(-0.5 AS DOUBLE) + b{k} * CAST(1.5 AS DOUBLE)') + f' AS b{k}' for k, low in enumerate(('0', '0', '0', '(255 - mean)')))} FROM rgba JOIN m USING (image_id)")
query("op_convert_i_cmyk", "l", lambda a: C.convert(a.withColumn("b0", F.col("b0") * 3 - 200), "I", "CMYK"), _some(["0", "0", "0", "255 - greatest(0, least(255, b0 * 3 - 200))"], "l"))
_WEB_SQL = ORACLE_SQL["op_web_palette"].rsplit(f"SELECT {PLACE}, CAST(i AS INTEGER) AS b0", 1)
QUERIES["op_convert_pa"] = lambda spark, d: R.convert_to_palette(C.convert(READERS["rgb"](spark, d), "RGB", "CMYK"), "CMYK", True)[0]
ORACLE_SQL["op_convert_pa"] = f"SELECT {PLACE}, CAST(i AS INTEGER) AS b0, 255 AS b1".join(_WEB_SQL)
query("op_convert_pa_rgba", "rgba", lambda a: C.expand_palette(*R.convert_to_palette(a, "RGBA", True), alpha=True), f"SELECT {PLACE}, b0, b1, b2, b3 FROM rgba")

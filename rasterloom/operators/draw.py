"""Drawing. A shape is rows of spans (functions.shapes), made from its parameters on the driver; drawing is one
projection that looks spans up by row: in a literal map where they are few, by a join with a small relation of them
where they are more. Fill and outline are one look-up, and what they share is settled before."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions.samples import clip, quotient
from ..functions.shapes import Point, Span
from ..relation import KEYS, bands, with_rows

#: Spans that a plan holds as literals; more are joined, and up to the second number broadcast.
LITERAL_SPANS, BROADCAST_SPANS = 256, 1_000_000


class Layers:
    """Coats of paint, the last on top. A coat's spans may differ in rows that are an image's last."""

    def __init__(self) -> None:
        self.paints: list[Sequence[int]] = []
        #: row (or -1 - row where it is the image's last) -> layer -> pieces.
        self.rows: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(dict)
        self.last: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(dict)

    def paint(self, fill: Sequence[int] | None, spans: Iterable[Span], final: Iterable[Span] = ()) -> Layers:
        if fill is not None:
            layer = len(self.paints)
            self.paints.append(fill)
            for to, own in ((self.rows, spans), (self.last, final)):
                for y, a, b in own:
                    if y >= 0:
                        to[y].setdefault(layer, []).append((a, b))
        return self

    def resolved(self) -> dict[int, list[tuple[int, int, int]]]:
        """key -> disjoint (a, b, layer): what is on top."""
        out = {y: _topmost(own) for y, own in self.rows.items()}
        out |= {-1 - y: _topmost(self.rows.get(y, {}) | own) for y, own in self.last.items()}
        return {k: v for k, v in out.items() if v or k < 0}

    def on(self, df: DataFrame) -> DataFrame:
        rows = self.resolved()
        if not rows:
            return df
        special = sorted(-1 - k for k in rows if k < 0)
        y = F.col("y")
        key = F.when((y == F.col("h") - 1) & y.isin(special), -1 - y).otherwise(y) if special else y
        count = sum(map(len, rows.values()))
        if count <= LITERAL_SPANS:
            piece = lambda p: F.struct(*(F.lit(v).alias(n) for n, v in zip("abk", p, strict=True)))
            none = F.array().cast("array<struct<a:int,b:int,k:int>>")
            entries = [v for k, own in sorted(rows.items()) for v in (F.lit(k), F.array(*map(piece, own)) if own else none)]
            hit = F.filter(F.try_element_at(F.create_map(*entries), key), lambda p: F.col("x").between(p["a"], p["b"]))
            found = df.withColumn("__layer", F.get(hit, F.lit(0))["k"])
        else:
            table = df.sparkSession.createDataFrame([(k, *p) for k, own in rows.items() for p in own], "__row int, __a int, __b int, __layer int")
            table = F.broadcast(table) if count <= BROADCAST_SPANS else table
            found = df.withColumn("__key", key).join(table, (F.col("__key") == F.col("__row")) & F.col("x").between(F.col("__a"), F.col("__b")), "left")
        own = bands(df)
        value = {b: F.col(b) for b in own}
        for k, fill in enumerate(self.paints):
            value = {b: F.when(F.col("__layer") == k, v).otherwise(value[b]) for b, v in zip(own, fill, strict=True)}
        return found.select(*(value[c].alias(c) if c in value else F.col(c) for c in df.columns))


def _topmost(layers: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for k in sorted(layers, reverse=True):
        for a, b in S.merged(p for p in layers[k] if p[0] <= p[1]):
            for c, d, _ in sorted(p for p in out if p[1] >= a and p[0] <= b):
                if a < c:
                    out.append((a, c - 1, k))
                a = d + 1
            if a <= b:
                out.append((a, b, k))
    return sorted(out)


def _painted(df: DataFrame, cover: Column, fill: Sequence[int]) -> DataFrame:
    own = bands(df)
    return df.withColumns({b: F.when(cover, v).otherwise(F.col(b)) for b, v in zip(own, fill, strict=True)})


def _stroke(fill: Sequence[int] | None, outline: Sequence[int] | None, width: int) -> Sequence[int] | None:
    """The outline's paint, if it is to be seen."""
    return None if width < 1 or (fill is not None and outline is not None and list(outline) == list(fill)) else outline


def points(df: DataFrame, xy: Sequence[Point], fill: Sequence[int]) -> DataFrame:
    return Layers().paint(fill, ((int(y), int(x), int(x)) for x, y in xy)).on(df)


def line(df: DataFrame, xy: Sequence[Point], fill: Sequence[int], width: int = 1) -> DataFrame:
    """A chain of lines; wide ones are polygons around their middle, an even width a pixel wider on one side."""
    layers = Layers()
    for a, b in zip(xy, xy[1:], strict=False):
        layers.paint(fill, *S.segment_spans(a, b, width))
    return layers.on(df)


def rectangle(df: DataFrame, box: Sequence[float], fill=None, outline=None, width: int = 1) -> DataFrame:
    """Corners are part of it."""
    return Layers().paint(fill, S.rectangle_spans(box)).paint(outline if width > 0 else None, S.frame_spans(box, width)).on(df)


def ellipse(df: DataFrame, box: Sequence[float], fill=None, outline=None, width: int = 1) -> DataFrame:
    """The ellipse in a box whose corners are part of it; a wide outline grows inwards."""
    return Layers().paint(fill, S.ellipse_spans(box)).paint(_stroke(fill, outline, width), S.ellipse_spans(box, width)).on(df)


def circle(df: DataFrame, center: Point, radius: float, **paint) -> DataFrame:
    return ellipse(df, (center[0] - radius, center[1] - radius, center[0] + radius, center[1] + radius), **paint)


def polygon(df: DataFrame, xy: Sequence[Point], fill=None, outline=None, width: int = 1) -> DataFrame:
    """Its inside by pairs of crossings, with its sides; a wide outline stays inside the polygon."""
    cover, final = S.polygon_spans(xy)
    layers = Layers().paint(fill, cover, final)
    sides = list(zip(xy, [*xy[1:], xy[0]], strict=True)) if xy else []
    stroke = _stroke(fill, outline, width)
    for a, b in sides:
        if width <= 1:
            layers.paint(stroke, *S.segment_spans(a, b, 1))
        else:
            layers.paint(stroke, *S.inside(S.segment_spans(a, b, 2 * width - 1), (cover, final)))
    return layers.on(df)


def regular_polygon_points(center: Point, radius: float, sides: int, rotation: float = 0) -> list[Point]:
    turn = 360 / sides
    angles = [math.radians(turn / 2 + k * turn + 90 - rotation) for k in range(sides)]
    return [(round(center[0] + radius * math.cos(t), 2), round(center[1] + radius * math.sin(t), 2)) for t in angles]


def regular_polygon(df: DataFrame, center: Point, radius: float, sides: int, rotation: float = 0, **paint) -> DataFrame:
    if sides < 3 or radius <= 0:
        raise ValueError("a polygon has three sides or more, and a radius over 0")
    return polygon(df, regular_polygon_points(center, radius, sides, rotation), **paint)


def _arc_spans(box: Sequence[float], start: float, end: float, width: int) -> list[Span]:
    x0, y0, x1, y1 = (int(v) for v in box)
    s, e = S.turned(start, end)
    if s == e:
        return []
    return S.ellipse_spans(box, width, None if e == s + 360 else S.arc_region(x1 - x0, y1 - y0, s, e))


def arc(df: DataFrame, box: Sequence[float], start: float, end: float, fill: Sequence[int], width: int = 1) -> DataFrame:
    """The outer ``width`` pixels of an ellipse between two angles, clockwise from three o'clock."""
    return Layers().paint(fill, _arc_spans(box, start, end, width)).on(df)


def chord(df: DataFrame, box: Sequence[float], start: float, end: float, fill=None, outline=None, width: int = 1) -> DataFrame:
    """The part of the ellipse beyond the line from the start angle's point to the end angle's."""
    x0, y0, x1, y1 = (int(v) for v in box)
    a, b = x1 - x0, y1 - y0
    s, e = S.turned(start, end)
    if e == s + 360:
        return ellipse(df, box, fill, outline, width)
    if s == e or a < 0 or b < 0:
        return df
    stroke, beyond = _stroke(fill, outline, width), S.chord_region(a, b, s, e)
    layers = Layers().paint(fill, S.ellipse_spans(box, a + b + 1, beyond))
    layers.paint(stroke, S.ellipse_spans(box, a + b + 1, S.chord_region(a, b, s, e, width)))
    return layers.paint(stroke, S.ellipse_spans(box, width, beyond)).on(df)


def _slice_spans(box: Sequence[float], start: float, end: float) -> list[Span]:
    x0, y0, x1, y1 = (int(v) for v in box)
    s, e = S.turned(start, end)
    return [] if s == e else S.ellipse_spans(box, None, None if e == s + 360 else S.slice_region(x1 - x0, y1 - y0, s, e))


def pieslice(df: DataFrame, box: Sequence[float], start: float, end: float, fill=None, outline=None, width: int = 1) -> DataFrame:
    """The part of the ellipse between two angles, with strokes to the middle."""
    x0, y0, x1, y1 = (int(v) for v in box)
    a, b = x1 - x0, y1 - y0
    s, e = S.turned(start, end)
    if e == s + 360:
        return ellipse(df, box, fill, outline, width)
    if s == e or a < 0 or b < 0:
        return df
    stroke = _stroke(fill, outline, width)
    layers = Layers().paint(fill, _slice_spans(box, start, end))
    for angle in (s, e):
        layers.paint(stroke, S.ellipse_spans(box, a + b + 1, S.radius_region(a, b, angle, width)))
    cx, cy = S.nearest((x0 + x1 - width) / 2), S.nearest((y0 + y1 - width) / 2)
    layers.paint(stroke, S.ellipse_spans((cx, cy, cx + width - 1, cy + width - 1), 2 * width - 2))
    return layers.paint(stroke, S.ellipse_spans(box, width, S.slice_region(a, b, s, e))).on(df)


def rounded_rectangle(df: DataFrame, box: Sequence[float], radius: float, fill=None, outline=None, width: int = 1, corners=(True,) * 4) -> DataFrame:
    """Corners are upper left, upper right, lower right, lower left."""
    x0, y0, x1, y1 = (int(v) for v in box)
    if x1 < x0 or y1 < y0:
        raise ValueError("a box ends at or after its start")
    across = down = False
    d = radius * 2.0
    if all(corners):
        across = d >= x1 - x0 - 1
        d = x1 - x0 if across else d
        down = across and d >= y1 - y0 - 1
        d = y1 - y0 if down else d
        if across and down:
            return ellipse(df, box, fill, outline, width)
    d = int(d)
    if d == 0 or not any(corners):
        return rectangle(df, box, fill, outline, width)
    r = d // 2
    stroke = _stroke(fill, outline, width)
    squares = [((x0, y0, x0 + d, y0 + d), 180), ((x1 - d, y0, x1, y0 + d), 270), ((x1 - d, y1 - d, x1, y1), 0), ((x0, y1 - d, x0 + d, y1), 90)]
    if across:
        turns = [((x0, y0, x0 + d, y0 + d), 180, 360), ((x0, y1 - d, x0 + d, y1), 0, 180)]
    else:
        turns = [(square, start, start + 90) for (square, start), on in zip(squares, corners, strict=True) if on]
    # A corner that is not rounded is a rectangle, and the edges go on through it.
    tl, tr, br, bl = corners
    plain = [] if across else [s for s, on in zip(
        [(x0, y0, x0 + r, y0 + r), (x1 - r, y0, x1, y0 + r), (x1 - r, y1 - r, x1, y1), (x0, y1 - r, x0 + r, y1)], corners, strict=True) if not on]
    inner = [] if across else [(x0 + r + 1, y0, x1 - r - 1, y1), (x0, y0 + r + 1, x0 + r, y1 - r - 1), (x1 - r, y0 + r + 1, x1, y1 - r - 1)]
    inner = [(x0, y0 + r + 1, x1, y1 - r - 1)] if across else inner
    start = lambda on, at: at + r + 1 if on else at
    stop = lambda on, at: at - r - 1 if on else at
    edges = [] if across else [(start(tl, x0), y0, stop(tr, x1), y0 + width - 1), (start(bl, x0), y1 - width + 1, stop(br, x1), y1)]
    edges += [(x0, start(tl, y0), x0 + width - 1, stop(bl, y1)), (x1 - width + 1, start(tr, y0), x1, stop(br, y1))]
    layers = Layers()
    for square, s, e in turns:
        layers.paint(fill, _slice_spans(square, s, e))
    for part in inner + plain:
        layers.paint(fill, S.rectangle_spans(part))
    for square, s, e in turns:
        layers.paint(stroke, _arc_spans(square, s, e, width))
    for part in edges:
        layers.paint(stroke, S.rectangle_spans(part))
    return layers.on(df)


def bitmap(df: DataFrame, at: tuple[int, int], mask: DataFrame, fill: Sequence[int]) -> DataFrame:
    """The fill through a mask (L or 1) from a corner on."""
    own = bands(df)
    level = mask.select("image_id", (F.col("x") + at[0]).alias("x"), (F.col("y") + at[1]).alias("y"), F.col("b0").alias("m"))
    joined = with_rows(df, level, ["image_id", "x", "y"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    mix = lambda b, v: quotient(F.col("m") * v + F.col(b) * (255 - F.col("m")) + 127, 255)
    return joined.select(*KEYS, *(mix(b, v).alias(b) for b, v in zip(own, fill, strict=True)))


def put_pixel(df: DataFrame, xy: tuple[int, int], value: Sequence[int]) -> DataFrame:
    return _painted(df, (F.col("x") == xy[0]) & (F.col("y") == xy[1]), value)


def get_pixel(df: DataFrame, xy: tuple[int, int]) -> DataFrame:
    return df.where((F.col("x") == xy[0]) & (F.col("y") == xy[1])).select("image_id", *bands(df))


def put_data(df: DataFrame, values: DataFrame, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """L pixels by (image_id, values), an array in row order; pixels beyond its end stay."""
    rows = values.select("image_id", F.posexplode("values").alias("i", "v"))
    at = with_rows(df.withColumn("i", F.col("y") * F.col("w") + F.col("x")), rows, ["image_id", "i"], "left")
    return at.select(*KEYS, F.when(F.col("v").isNull(), F.col("b0")).otherwise(clip(F.col("v") * F.lit(float(scale)) + F.lit(float(offset)))).alias("b0"))


def text(df: DataFrame, at: tuple[int, int], words: DataFrame, font: DataFrame, fill: Sequence[int]) -> DataFrame:
    """Each image's string (image_id, text) in a bitmap font: rows (code, advance, width, gx, gy) of set
    pixels, with at least one row a glyph (gx null for a blank one)."""
    pixels = text_pixels(words, font).select("image_id", (F.col("px") + at[0]).alias("x"), (F.col("py") + at[1]).alias("y")).distinct()
    joined = with_rows(df, pixels.withColumn("hit", F.lit(1)), ["image_id", "x", "y"], "left")
    return joined.select(*KEYS, *(F.when(F.col("hit") == 1, v).otherwise(F.col(b)).alias(b) for b, v in zip(bands(df), fill, strict=True)))


def text_layout(words: DataFrame, font: DataFrame) -> DataFrame:
    """(image_id, i, code, origin): characters with the sum of the advances before them."""
    glyphs = font.groupBy("code").agg(F.max("advance").alias("advance"))
    chars = words.select("image_id", F.posexplode(F.split("text", "", -1)).alias("i", "c")).where("c <> ''").select("image_id", "i", F.ascii("c").alias("code"))
    order = Window.partitionBy("image_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return chars.join(glyphs, "code").withColumn("origin", F.coalesce(F.sum("advance").over(order), F.lit(0)).cast("int"))


def text_length(words: DataFrame, font: DataFrame) -> DataFrame:
    """(image_id, length): the sum of advances."""
    return text_layout(words, font).groupBy("image_id").agg(F.sum("advance").alias("length"))


def text_pixels(words: DataFrame, font: DataFrame) -> DataFrame:
    placed = text_layout(words, font).select("image_id", "i", "code", "origin")
    return placed.join(font.where("gx is not null").select("code", "gx", "gy"), "code").select("image_id", (F.col("origin") + F.col("gx")).alias("px"), F.col("gy").alias("py"))


def text_bbox(words: DataFrame, font: DataFrame) -> DataFrame:
    """(image_id, left, upper, right, lower) of the text's set pixels, half-open."""
    return text_pixels(words, font).groupBy("image_id").agg(
        F.min("px").alias("left"), F.min("py").alias("upper"), (F.max("px") + 1).alias("right"), (F.max("py") + 1).alias("lower"))

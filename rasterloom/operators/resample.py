"""Resampling. Weights are a relation of their own, (size, src, out, weight), made from the distinct sizes;
an image is resized by joining it with the weights of its width, summing, and the same for its height."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.samples import clip
from ..relation import KEYS, bands, grid, sizes, with_rows
from .geometry import crop, pad_to, premultiplied, unmultiplied

PRECISION = 22
_LENGTH = ("size", "out_size", "lo", "hi")
#: What a resize carries on its rows: sizes to come and the box that is cut out.
_PLAN = ("out_w", "out_h", "x0", "y0", "x1", "y1")


def _sinc(x: Column) -> Column:
    return F.when(x == 0.0, 1.0).otherwise(F.sin(x * math.pi) / (x * math.pi))


def _bicubic(x: Column) -> Column:
    a, x = -0.5, F.abs(x)
    near = ((x * (a + 2.0) - (a + 3.0)) * x) * x + 1.0
    far = (((x - 5.0) * x + 8.0) * x - 4.0) * a
    return F.when(x < 1.0, near).when(x < 2.0, far).otherwise(0.0)


#: name -> (support, kernel).
FILTERS = {
    "BOX": (0.5, lambda x: F.when((x > -0.5) & (x <= 0.5), 1.0).otherwise(0.0)),
    "BILINEAR": (1.0, lambda x: F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(x))),
    "HAMMING": (1.0, lambda x: F.when(F.abs(x) >= 1.0, 0.0).otherwise(_sinc(F.abs(x)) * (F.cos(F.abs(x) * math.pi) * 0.46 + 0.54))),
    "BICUBIC": (2.0, _bicubic),
    "LANCZOS": (3.0, lambda x: F.when((x >= -3.0) & (x < 3.0), _sinc(x) * _sinc(x / 3.0)).otherwise(0.0)),
}


def weights(lengths: DataFrame, resample: str) -> DataFrame:
    """(size, out_size, lo, hi, src, out, wd, wt) of rows (size, out_size, lo, hi): for each of out_size places of
    the stretch lo..hi of a line, the places it is made from, with weights that sum to 1 (wd) and the same in
    fixed point (wt)."""
    support, kernel = FILTERS[resample]
    rows = lengths.where("out_size > 0 and size > 0").withColumn("out", F.explode(F.expr("sequence(0, out_size - 1)")))
    scale = (F.col("hi") - F.col("lo")) / F.col("out_size")
    stretch = F.greatest(scale, F.lit(1.0))
    rows = rows.withColumns({"centre": F.col("lo") + (F.col("out") + 0.5) * scale, "stretch": stretch})
    first = F.greatest(F.lit(0), (F.col("centre") - F.col("stretch") * support + 0.5).cast("int"))
    last = F.least(F.col("size"), (F.col("centre") + F.col("stretch") * support + 0.5).cast("int"))
    rows = rows.withColumns({"a": first, "b": last}).where("b > a")
    value = lambda s: kernel((s + 0.5 - F.col("centre")) * (F.lit(1.0) / F.col("stretch")))
    rows = rows.withColumn("ks", F.transform(F.sequence(F.col("a"), F.col("b") - 1), value))
    rows = rows.withColumn("total", F.aggregate("ks", F.lit(0.0), lambda s, k: s + k))
    rows = rows.select(*_LENGTH, "out", "a", "total", F.posexplode("ks").alias("i", "k"))
    wd = F.when(F.col("total") != 0, F.col("k") / F.col("total")).otherwise(F.col("k"))
    fixed = wd * float(1 << PRECISION)
    return rows.select(*_LENGTH, (F.col("a") + F.col("i")).cast("int").alias("src"), F.col("out").cast("int").alias("out"), wd.alias("wd"),
                       F.when(wd >= 0, fixed + 0.5).otherwise(fixed - 0.5).cast("bigint").alias("wt"))


def _nearest(lengths: DataFrame) -> DataFrame:
    """As weights(): the one source place of each of out_size places."""
    rows = lengths.where("out_size > 0 and size > 0").withColumn("out", F.explode(F.expr("sequence(0, out_size - 1)")))
    at = F.floor((F.col("out") + 0.5) * (F.col("hi") - F.col("lo")) / F.col("out_size") + F.col("lo"))
    return rows.select(*_LENGTH, F.least(F.col("size") - 1, at).cast("int").alias("src"), F.col("out").cast("int").alias("out"), F.lit(1.0).alias("wd"), F.lit(1 << PRECISION).cast("bigint").alias("wt"))


def _table(df: DataFrame, axis: str, resample: str) -> DataFrame:
    """Weights of the distinct lengths of df's images along an axis, under the names of df's columns."""
    size = "w" if axis == "x" else "h"
    length = dict(zip((size, f"out_{size}", f"{axis}0", f"{axis}1"), _LENGTH, strict=True))
    lengths = df.select(*(F.col(c).alias(n) for c, n in length.items())).distinct()
    table = _nearest(lengths) if resample == "NEAREST" else weights(lengths, resample)
    return table.withColumnsRenamed({n: c for c, n in length.items()} | {"src": axis})


def _pass(df: DataFrame, table: DataFrame, axis: str, exact: bool) -> DataFrame:
    """One axis: the rows know their own image's length and box."""
    size, other = ("w", "y") if axis == "x" else ("h", "x")
    length = (size, f"out_{size}", f"{axis}0", f"{axis}1")
    own = bands(df)
    joined = df.join(table, [*length, axis])
    kept = [c for c in ("image_id", "w", "h", *_PLAN, other) if c in df.columns and c not in (size, f"{axis}0", f"{axis}1")]
    keys = [*kept, F.col("out").alias(axis)]
    if exact:
        sums = joined.groupBy(*keys).agg(*(F.sum(F.col(b) * F.col("wd")).alias(b) for b in own))
    else:
        value = lambda b: clip(F.shiftright(F.sum(F.col(b) * F.col("wt")) + (1 << (PRECISION - 1)), PRECISION))
        sums = joined.groupBy(*keys).agg(*(value(b).alias(b) for b in own))
    return sums.withColumnRenamed(f"out_{size}", size)


def resize_plan(df: DataFrame, plan: Sequence[Column], resample: str, alpha: bool = False, exact: bool = False) -> DataFrame:
    """df by a plan of columns (out_w, out_h, x0, y0, x1, y1) of an image's w and h: its size and its box."""
    if alpha and resample != "NEAREST":
        df = premultiplied(df)
    kinds = ("int", "int", *["double"] * 4)
    df = df.withColumns({n: c.cast(k) for n, c, k in zip(_PLAN, plan, kinds, strict=True)})
    tables = {axis: _table(df, axis, resample) for axis in ("x", "y")}
    for axis, table in tables.items():
        df = _pass(df, table, axis, exact)
    df = df.select(*KEYS, *bands(df))
    if alpha and resample != "NEAREST":
        df = unmultiplied(df)
    return df


def _whole(w: Column, h: Column) -> list[Column]:
    return [w, h, F.lit(0), F.lit(0), F.col("w"), F.col("h")]


def resize(df: DataFrame, size: tuple[int, int], resample: str = "BICUBIC", box: Sequence[int] | None = None, alpha: bool = False, exact: bool = False) -> DataFrame:
    """To a size; a box is cut out first. ``alpha``: the last band is alpha, samples are weighted by it.
    ``exact``: samples are I or F, without rounding or bounds."""
    df = crop(df, box) if box is not None else df
    return resize_plan(df, _whole(F.lit(size[0]), F.lit(size[1])), resample, alpha, exact)


def _ratio(x: Column, y: Column) -> Column:
    """The whole number next to x (at least 1) that brings y(x) nearest to zero, the lower of equals."""
    low, high = F.greatest(F.floor(x), F.lit(1)), F.greatest(F.ceil(x), F.lit(1))
    return F.when(y(low) <= y(high), low).otherwise(high).cast("int")


def thumbnail(df: DataFrame, size: tuple[int, int], resample: str = "BICUBIC") -> DataFrame:
    """Shrunk to fit, in its proportion; smaller images stay."""
    w, h = F.col("w"), F.col("h")
    aspect = w / h
    bw, bh = F.lit(size[0]), F.lit(size[1])
    wide = F.lit(size[0] / size[1]) >= aspect
    out_w = F.when(wide, _ratio(aspect * bh, lambda n: F.abs(aspect - n / bh))).otherwise(bw)
    out_h = F.when(wide, bh).otherwise(_ratio(bw / aspect, lambda n: F.when(n == 0, 0.0).otherwise(F.abs(aspect - bw / n))))
    small = (bw >= w) & (bh >= h)
    return resize_plan(df, _whole(F.when(small, w).otherwise(out_w), F.when(small, h).otherwise(out_h)), resample)


def _fitting(size: tuple[int, int], inner: bool) -> tuple[Column, Column]:
    w, h = F.col("w"), F.col("h")
    ratio, wanted = w / h, size[0] / size[1]
    by_width = (ratio > wanted) if inner else (ratio < wanted)
    by_height = (ratio < wanted) if inner else (ratio > wanted)
    out_h = F.when(by_width, F.bround(h / w * size[0])).otherwise(size[1]).cast("int")
    out_w = F.when(by_height, F.bround(w / h * size[1])).otherwise(size[0]).cast("int")
    return out_w, out_h


def contain(df: DataFrame, size: tuple[int, int], resample: str = "BICUBIC") -> DataFrame:
    """The largest size in proportion that fits."""
    return resize_plan(df, _whole(*_fitting(size, True)), resample)


def cover(df: DataFrame, size: tuple[int, int], resample: str = "BICUBIC") -> DataFrame:
    """The least size in proportion that covers."""
    return resize_plan(df, _whole(*_fitting(size, False)), resample)


def fit(df: DataFrame, size: tuple[int, int], resample: str = "BICUBIC", bleed: float = 0.0, centering: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Cut to the size's proportion and resized."""
    w, h = F.col("w"), F.col("h")
    cw, ch = (c if 0 <= c <= 1 else 0.5 for c in centering)
    bleed = bleed if 0 <= bleed < 0.5 else 0.0
    live_w, live_h = w - w * (2 * bleed), h - h * (2 * bleed)
    ratio, wanted = live_w / live_h, size[0] / size[1]
    cut_w = F.when(ratio == wanted, live_w).when(ratio >= wanted, live_h * wanted).otherwise(live_w)
    cut_h = F.when(ratio == wanted, live_h).when(ratio >= wanted, live_h).otherwise(live_w / wanted)
    x0 = w * bleed + (live_w - cut_w) * cw
    y0 = h * bleed + (live_h - cut_h) * ch
    f32 = lambda c: c.cast("float").cast("double")
    plan = [F.lit(size[0]), F.lit(size[1]), f32(x0), f32(y0), f32(x0 + cut_w), f32(y0 + cut_h)]
    return resize_plan(df, plan, resample)


def pad(df: DataFrame, size: tuple[int, int], fill: Sequence[int], resample: str = "BICUBIC", centering: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """contain(), on a canvas of the size."""
    inner = contain(df, size, resample)
    cx, cy = (max(0.0, min(1.0, c)) for c in centering)
    left, top = (F.bround((F.lit(s) - F.col(n)) * c).cast("int") for s, n, c in ((size[0], "w", cx), (size[1], "h", cy)))
    return pad_to(inner, *size, left, top, fill)


def scale(df: DataFrame, factor: float, resample: str = "BICUBIC") -> DataFrame:
    size = lambda n: F.bround(F.col(n) * F.lit(float(factor))).cast("int")
    return resize_plan(df, _whole(size("w"), size("h")), resample) if factor != 1 else df


#: Taps a side of the filters that sample at a place, and the first one's offset.
SAMPLERS = {"NEAREST": (1, 0), "BILINEAR": (2, 0), "BICUBIC": (4, -1)}
#: A tile is 32 by 32 pixels, and as many more at its edges as the taps of its last places need.
TILE_BITS = 5


def _mixed(v: Sequence[Column], d: Column) -> Column:
    """Two values by their share, or four by the cubic with a = -1 between the middle ones. Equal values give just that value."""
    if len(v) == 2:
        return v[0] + (v[1] - v[0]) * d
    return v[1] + d * ((v[2] - v[0]) + d * ((2 * (v[0] - v[1]) + v[2] - v[3]) + d * (v[1] - v[0] + v[3] - v[2])))


def _span(tile: Column, size: Column, first: int, taps: int) -> tuple[Column, Column]:
    """The first place of a tile along an axis, and how many it has."""
    start = F.greatest(F.shiftleft(tile, TILE_BITS) + first, F.lit(0))
    return start, F.least(F.shiftleft(tile + 1, TILE_BITS) + (first + taps - 1), size) - start


def _tiles(df: DataFrame, first: int, taps: int) -> DataFrame:
    """(image_id, tx, ty, s0, ...): samples of tiles in row order, a band an array; places without a pixel are null, and of
    pixels at one place the highest sample counts."""
    own = bands(df)
    reach = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.shiftright(F.col(c) - (first + taps - 1), TILE_BITS)), F.least(F.shiftright(F.col(n) - 1, TILE_BITS), F.shiftright(F.col(c) - first, TILE_BITS))))
    rows = df.withColumn("tx", reach("x", "w")).withColumn("ty", reach("y", "h"))
    (x0, nx), (y0, ny) = _span(F.col("tx"), F.col("w"), first, taps), _span(F.col("ty"), F.col("h"), first, taps)
    at = ((F.col("y") - y0) * nx + (F.col("x") - x0)).cast("int").alias("at")
    found = rows.groupBy("image_id", "tx", "ty").agg(F.array_sort(F.collect_list(F.struct(at, *own))).alias("p"), F.any_value((nx * ny).cast("int")).alias("n"))
    dense = (F.size("p") == F.col("n")) & (F.size(F.array_distinct("p.at")) == F.col("n"))
    each = lambda b: F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.array_max(F.transform(F.filter("p", lambda e: e["at"] == k), lambda e: e[b])))
    return found.withColumn("dense", dense).select("image_id", "tx", "ty", *(F.when(F.col("dense"), F.col(f"p.{b}")).otherwise(each(b)).alias(f"s{b[1:]}") for b in own))


def _sampled(places: DataFrame, df: DataFrame, resample: str, fill: Sequence[int], alpha: bool = False, exact: bool = False) -> DataFrame:
    """Samples of df at the places (image_id, w, h, x, y, iw, ih, sx, sy): iw and ih are the size of df's image, sx and sy are
    doubles, a pixel's middle at .5. Places outside the image get the fill; taps beyond its edge are the edge's. ``alpha``: the
    last band is alpha, samples are weighted by it, the fill is taken as weighted. ``exact``: samples are I or F, without
    bounds. A place is one row, joined with the tile that has all its taps."""
    if resample not in SAMPLERS:
        raise ValueError(f"{resample} does not sample at a place; {', '.join(SAMPLERS)} do")
    if alpha and resample != "NEAREST":
        return unmultiplied(_sampled(places, premultiplied(df), resample, fill))
    own = bands(df)
    if resample == "NEAREST":
        source = df.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), *own)
        at = places.select(*KEYS, F.floor("sx").cast("int").alias("px"), F.floor("sy").cast("int").alias("py"))
        joined = with_rows(at, source, ["image_id", "px", "py"], "left")
        return joined.select(*KEYS, *(F.coalesce(F.col(b), F.lit(v)).alias(b) for b, v in zip(own, fill, strict=True)))
    taps, first = SAMPLERS[resample]
    inside = F.expr("sx >= 0 and sy >= 0 and sx < iw and sy < ih")
    x, y = F.col("sx") - 0.5, F.col("sy") - 0.5
    tile = lambda v: F.when(inside, F.shiftright(F.greatest(F.lit(0), F.floor(v).cast("int")), TILE_BITS))
    joined = with_rows(places.withColumns({"tx": tile(x), "ty": tile(y)}), _tiles(df, first, taps), ["image_id", "tx", "ty"], "left")
    near = lambda v, k, n: F.greatest(F.lit(0), F.least(F.floor(v).cast("int") + first + k, F.col(n) - 1))
    (x0, nx), (y0, _) = _span(F.col("tx"), F.col("iw"), first, taps), _span(F.col("ty"), F.col("ih"), first, taps)
    across, down = ([near(x, k, "iw") - x0 for k in range(taps)], [(near(y, k, "ih") - y0) * nx for k in range(taps)])
    some = lambda samples: F.exists(samples, lambda v: v.isNotNull())
    # Whole-stage code of all this is one method, too long to be compiled in time. A higher-order function in a step ends it.
    at = joined.select(*KEYS, *(f"s{b[1:]}" for b in own), *(v.alias(f"{n}{k}") for n, vs in (("i", across), ("j", down)) for k, v in enumerate(vs)),
                       (x - F.floor(x)).alias("fx"), (y - F.floor(y)).alias("fy"), some(f"s{own[0][1:]}").alias("tile"))
    grid_of = [f"t{i}{j}" for j in range(taps) for i in range(taps)]
    for b, v in zip(own, fill, strict=True):
        at = at.withColumns({t: F.get(f"s{b[1:]}", F.col(f"i{t[1]}") + F.col(f"j{t[2]}")) for t in grid_of})
        at = at.withColumns({f"v{j}": _mixed([F.col(f"t{i}{j}") for i in range(taps)], F.col("fx")) for j in range(taps)} | {"some": some(F.array(*grid_of))})
        mixed = _mixed([F.col(f"v{j}") for j in range(taps)], F.col("fy"))
        at = at.withColumn(b, F.coalesce(F.when(F.col("tile") & F.col("some"), mixed if exact else clip(mixed)), F.lit(v)))
        at = at.drop("some", f"s{b[1:]}", *grid_of, *(f"v{j}" for j in range(taps)))
    return at.select(*KEYS, *own)


def _places(df: DataFrame, size: tuple[int, int] | None) -> DataFrame:
    """Every place of images of the size, with that of df's image."""
    frames = sizes(df).withColumns({"iw": F.col("w"), "ih": F.col("h")})
    return grid(frames if size is None else frames.withColumns({"w": F.lit(size[0]), "h": F.lit(size[1])}))


def transform_affine(df: DataFrame, size: tuple[int, int], c: Sequence[float], resample: str = "NEAREST", fill: Sequence[int] | None = None, alpha: bool = False) -> DataFrame:
    """Each place's sample is from (c0 x + c1 y + c2, c3 x + c4 y + c5), taken at the middle of pixels; the
    nearest one's place is in 16-bit fixed point."""
    fill = [0] * len(bands(df)) if fill is None else fill
    x, y = F.col("x"), F.col("y")
    if resample == "NEAREST":
        fix = [math.floor(v * 65536.0 + 0.5) for v in (c[0], c[1], c[2] + c[0] * 0.5 + c[1] * 0.5, c[3], c[4], c[5] + c[3] * 0.5 + c[4] * 0.5)]
        sx, sy = ((x * F.lit(fix[k]).cast("bigint") + y * F.lit(fix[k + 1]).cast("bigint") + F.lit(fix[k + 2]).cast("bigint")) / 65536.0 for k in (0, 3))
    else:
        sx, sy = (F.lit(float(c[k])) * (x + 0.5) + F.lit(float(c[k + 1])) * (y + 0.5) + F.lit(float(c[k + 2])) for k in (0, 3))
    return _sampled(_places(df, size).withColumns({"sx": sx, "sy": sy}), df, resample, fill, alpha)


def rotate(df: DataFrame, angle: float, resample: str = "NEAREST", expand: bool = False, center: tuple[float, float] | None = None,
           translate: tuple[float, float] = (0, 0), fill: Sequence[int] | None = None, alpha: bool = False) -> DataFrame:
    """Counter-clockwise by degrees around the middle (or a centre), on the same canvas or on one that holds
    all of it. Each image by its own size."""
    from .geometry import transpose

    if resample not in SAMPLERS:
        raise ValueError(f"{resample} does not sample at a place; {', '.join(SAMPLERS)} do")
    angle = angle % 360.0
    plain = center is None and tuple(translate) == (0, 0)
    if plain and angle == 0:
        return df
    if plain and (angle == 180 or (angle in (90, 270) and expand)):
        return transpose(df, f"ROTATE_{int(angle)}")
    fill = [0] * len(bands(df)) if fill is None else fill
    turn = -math.radians(angle)
    a, b, d, e = (round(v, 15) for v in (math.cos(turn), math.sin(turn), -math.sin(turn), math.cos(turn)))
    frames = sizes(df).select("image_id", F.col("w").alias("iw"), F.col("h").alias("ih"))
    iw, ih = F.col("iw"), F.col("ih")
    cx, cy = (iw / 2.0, ih / 2.0) if center is None else (F.lit(float(center[0])), F.lit(float(center[1])))
    tx, ty = map(float, translate)
    c = (-cx - tx) * a + (-cy - ty) * b + cx
    f = (-cx - tx) * d + (-cy - ty) * e + cy
    frames = frames.withColumns({"c": c, "f": f, "w": iw, "h": ih})
    if expand:
        corners = [(F.lit(0), F.lit(0)), (iw, F.lit(0)), (iw, ih), (F.lit(0), ih)]
        xs = [x * a + y * b + F.col("c") for x, y in corners]
        ys = [x * d + y * e + F.col("f") for x, y in corners]
        frames = frames.withColumns({
            "w": (F.ceil(F.greatest(*xs)) - F.floor(F.least(*xs))).cast("int"), "h": (F.ceil(F.greatest(*ys)) - F.floor(F.least(*ys))).cast("int")})
        dx, dy = -(F.col("w") - iw) / 2.0, -(F.col("h") - ih) / 2.0
        frames = frames.withColumns({"c": dx * a + dy * b + F.col("c"), "f": dx * d + dy * e + F.col("f")})
    fix = lambda v: F.floor(v * 65536.0 + 0.5)
    x, y = F.col("x"), F.col("y")
    if resample == "NEAREST":
        at = lambda p, q, r: (x * fix(F.lit(p)) + y * fix(F.lit(q)) + fix(F.col(r) + p * 0.5 + q * 0.5)) / 65536.0
    else:
        at = lambda p, q, r: (x + 0.5) * p + (y + 0.5) * q + F.col(r)
    places = grid(frames).withColumns({"sx": at(a, b, "c"), "sy": at(d, e, "f")})
    return _sampled(places.select(*KEYS, "iw", "ih", "sx", "sy"), df, resample, fill, alpha)


def transform_perspective(df: DataFrame, size: tuple[int, int], c: Sequence[float], resample: str = "NEAREST", fill: Sequence[int] | None = None, alpha: bool = False) -> DataFrame:
    fill = [0] * len(bands(df)) if fill is None else fill
    x, y = F.col("x") + 0.5, F.col("y") + 0.5
    below = x * float(c[6]) + y * float(c[7]) + 1.0
    at = lambda k: (x * float(c[k]) + y * float(c[k + 1]) + float(c[k + 2])) / below
    return _sampled(_places(df, size).withColumns({"sx": at(0), "sy": at(3)}), df, resample, fill, alpha)


def quad_coefficients(size: tuple[int, int], quad: Sequence[float]) -> list[float]:
    """For a target of the size: the bilinear map to a quadrilateral given by its corners at the upper left,
    lower left, lower right and upper right."""
    w, h = size
    out = []
    for k in (0, 1):
        nw, sw, se, ne = quad[k], quad[k + 2], quad[k + 4], quad[k + 6]
        out += [nw, (ne - nw) / w, (sw - nw) / h, (se - sw - ne + nw) / (w * h)]
    return out


def transform_mesh(df: DataFrame, size: tuple[int, int], mesh: Sequence[tuple[Sequence[int], Sequence[float]]], resample: str = "NEAREST", fill: Sequence[int] | None = None, alpha: bool = False) -> DataFrame:
    """Boxes of the target, each from a quadrilateral of the source; places in no box get the fill. Of boxes
    that overlap the last counts. The mesh is the caller's list: cases of one projection."""
    fill = [0] * len(bands(df)) if fill is None else fill
    x, y = F.col("x"), F.col("y")
    sx = sy = F.lit(None).cast("double")
    for box, quad in mesh:
        c = quad_coefficients((box[2] - box[0], box[3] - box[1]), quad)
        u, v = x - box[0] + 0.5, y - box[1] + 0.5
        inside = (x >= box[0]) & (x < box[2]) & (y >= box[1]) & (y < box[3])
        at = lambda k, c=c, u=u, v=v: F.lit(float(c[k])) + u * float(c[k + 1]) + v * float(c[k + 2]) + u * v * float(c[k + 3])
        sx, sy = F.when(inside, at(0)).otherwise(sx), F.when(inside, at(4)).otherwise(sy)
    return _sampled(_places(df, size).withColumns({"sx": sx, "sy": sy}), df, resample, fill, alpha)


def transform_quad(df: DataFrame, size: tuple[int, int], quad: Sequence[float], resample: str = "NEAREST", fill: Sequence[int] | None = None, alpha: bool = False) -> DataFrame:
    return transform_mesh(df, size, [((0, 0, *size), quad)], resample, fill, alpha)

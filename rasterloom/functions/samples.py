"""Arithmetic of 8-bit samples. All functions take and give int columns unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(v: Column) -> Column:
    """0..255; a fraction is dropped."""
    return F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int")


def clip_round(v: Column) -> Column:
    """Rounded half away from zero, then 0..255."""
    return clip(F.round(v))


def quotient(a: Column, b: int) -> Column:
    """a / b, truncated; both are whole."""
    return F.call_function("div", a, F.lit(b)).cast("int")


def muldiv255(a: Column, b: Column) -> Column:
    """About a * b / 255, the rounding of 8-bit blending."""
    t = a * b + 128
    return F.shiftright(F.shiftright(t, 8) + t, 8)


def luma(r: Column, g: Column, b: Column) -> Column:
    """BT.601 in 16-bit fixed point, rounded."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def luma_cut(r: Column, g: Column, b: Column) -> Column:
    """BT.601 without rounding, as the two-level conversion has it."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471, 16)


def lookup(table: list[int], v: Column) -> Column:
    """The table's entry at v. The table is a literal of the plan."""
    return F.element_at(F.array(*map(F.lit, table)), v + 1)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, ...]:
    nk = 255 - k
    return tuple(clip(nk - muldiv255(v, nk)) for v in (c, m, y))


def _scaled(coefficient: float, v: Column) -> Column:
    """coefficient * v in 6-bit fixed point, half up, then cut towards zero."""
    return (v * F.lit(coefficient * 64.0) + 0.5).cast("int")


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    mixed = lambda cr, cg, cb: F.shiftright(_scaled(cr, r) + _scaled(cg, g) + _scaled(cb, b), 6)
    return mixed(0.299, 0.587, 0.114), mixed(-0.16874, -0.33126, 0.5) + 128, mixed(0.5, -0.41869, -0.08131) + 128


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, ...]:
    cb, cr = cb - 128, cr - 128
    return (
        clip(y + F.shiftright(_scaled(1.402, cr), 6)),
        clip(y + F.shiftright(_scaled(-0.34414, cb) + _scaled(-0.71414, cr), 6)),
        clip(y + F.shiftright(_scaled(1.772, cb), 6)),
    )


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """Hue and saturation through 32-bit floats where those are stored, cut to whole numbers."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("float")
    share = lambda v: ((top.cast("float") - v.cast("float")) / span).cast("float").cast("double")
    turn = F.when(r == top, share(b) - share(g)).when(g == top, 2.0 + share(r) - share(b)).otherwise(4.0 + share(g) - share(r))
    hue = F.pmod(turn.cast("float").cast("double") / 6.0 + 1.0, F.lit(1.0)).cast("float").cast("double")
    saturation = (span / top.cast("float")).cast("float").cast("double")
    grey = top == low
    cut = lambda v: F.when(grey, 0).otherwise(F.floor(v * 255.0)).cast("int")
    return cut(hue), cut(saturation), top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, ...]:
    f32 = lambda c: c.cast("float")
    fs = f32(f32(s) / F.lit(255.0).cast("float"))
    turn = f32(f32(f32(h) * F.lit(6.0).cast("float")) / F.lit(255.0).cast("float"))
    sector = F.floor(turn).cast("int")
    part = f32(turn - f32(F.floor(turn)))
    one = F.lit(1.0).cast("float")
    level = lambda x: clip_round(f32(f32(v) * f32(one - x)).cast("double"))
    p, q, t = level(fs), level(f32(fs * part)), level(f32(fs * f32(one - part)))
    pick = lambda *six: F.when(s == 0, v).otherwise(F.element_at(F.array(*six), F.pmod(sector, F.lit(6)) + 1)).cast("int")
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)

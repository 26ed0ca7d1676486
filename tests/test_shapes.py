"""Spans of shapes against painting pixel by pixel, and their look-up by map and by join."""

import math
import random

import numpy as np
import pytest

from rasterloom.functions import shapes
from rasterloom.operators import draw


def filled(spans, size=40):
    out = np.zeros((size, size), bool)
    for y, a, b in spans:
        if 0 <= y < size and b >= max(a, 0):
            out[y, max(a, 0) : b + 1] = True
    return out


def walk(a, b):
    """Points of a quarter, one step at a time."""
    x, y = a, b % 2
    yield x, y
    while (x, y) != (a % 2, b):
        steps = [(x, y + 2)] + ([(x - 2, y + 2), (x - 2, y)] if x > 1 else [])
        errors = [abs(a * a * v * v + b * b * u * u - a * a * b * b) for u, v in steps]
        x, y = steps[errors.index(min(errors))]
        yield x, y


def ellipse_pixels(a, b, width, size=40):
    """Row by row from two walks: the outer one's first point, the inner one's last."""
    out = np.zeros((size, size), bool)
    if width < 1:
        return out
    inner = list(walk(a - 2 * (width - 1), b - 2 * (width - 1))) if min(a, b) >= 2 * (width - 1) else []
    seen = set()
    for x, y in walk(a, b):
        if y not in seen:
            seen.add(y)
            left = ([u for u, v in inner if v == y] or [a % 2])[-1]
            for u in range(-x, x + 1):
                if abs(u) >= left and (u - a) % 2 == 0:
                    for v in (y, -y):
                        out[(v + b) // 2, (u + a) // 2] = True
    return out


@pytest.mark.parametrize("a", [0, 1, 2, 3, 4, 7, 12, 31])
def test_ellipses_equal_their_walk(a):
    for b in (0, 1, 2, 3, 5, 8, 17, 30):
        for width in (1, 2, 3, 7, a + b):
            assert np.array_equal(filled(shapes.ellipse_spans((0, 0, a, b), width)), ellipse_pixels(a, b, width)), (a, b, width)
        whole = shapes.ellipse_spans((0, 0, a, b))
        assert np.array_equal(filled(whole), filled([(b - y, a - q, a - p) for y, p, q in whole]))


@pytest.mark.parametrize("box", [(2, 3, 33, 30), (5, 1, 20, 36), (0, 0, 30, 30), (4, 4, 5, 5)])
def test_arcs_make_up_the_ring(box):
    ring = filled(shapes.ellipse_spans(box, 3))
    for start in range(-90, 400, 15):
        for sweep in (1, 45, 90, 135, 179, 180, 181, 270, 359):
            one, other = (filled(draw._arc_spans(box, s, e, 3)) for s, e in ((start, start + sweep), (start + sweep, start + 360)))
            assert np.array_equal(one | other, ring), (start, sweep)
            assert (one & other).sum() <= 30, (start, sweep)
    assert np.array_equal(filled(draw._arc_spans(box, 10, 370, 3)), ring) and draw._arc_spans(box, 50, 50, 3) == []


def test_arcs_turn_with_their_angles():
    """Quarter turns of a circle's arc are arcs of quarter turns; upright ellipses are lying ones exchanged."""
    box = (3, 3, 34, 34)
    for start in range(0, 360, 10):
        one = filled(draw._arc_spans(box, start, start + 40, 4), 38)
        turned = filled(draw._arc_spans(box, start + 90, start + 130, 4), 38)
        assert (np.rot90(one, -1) ^ turned).sum() <= 8
    lying, upright = filled(draw._arc_spans((3, 6, 34, 20), 20, 100, 3)), filled(draw._arc_spans((6, 3, 20, 34), -10, 70, 3))
    assert (lying.T ^ upright).sum() <= 8


def brute_polygon(xy, size):
    """By scanning rows for crossings, one after the other, in single precision."""
    f = np.float32
    out = np.zeros((size, size), bool)
    sides = [(a, b) for a, b in zip(xy, xy[1:] + xy[:1], strict=True) if a != b]
    last = min(max(max(a[1], b[1]) for a, b in sides), size - 1)
    for (ax, ay), (bx, by) in sides:
        if ay == by and 0 <= ay < size:
            out[ay, max(0, min(ax, bx)) : max(0, max(ax, bx) + 1)] = True
    slanted = [(a, b, f(b[0] - a[0]) / f(b[1] - a[1])) for a, b in sides if a[1] != b[1]]
    at = lambda s, y: f(y - s[0][1]) * s[2] + f(s[0][0])
    half = lambda v: math.copysign(math.floor(abs(float(v)) + 0.5), v)
    for y in range(last + 1):
        cuts = []
        for k, s in enumerate(slanted):
            lo, hi = sorted((s[0][1], s[1][1]))
            if not lo <= y <= hi:
                continue
            x = at(s, y)
            cuts.append(x)
            if y == hi and y < last:
                cuts.append(x)
            elif y in (lo, hi) and s[2] != 0:
                to = y - 1 if y == hi else y + 1
                for o in slanted[:k]:
                    span = sorted((o[0][1], o[1][1]))
                    if y in span and o[2] != 0 and half(at(o, y)) == half(x) and span[0] <= to <= span[1]:
                        p, q = at(s, to), at(o, to)
                        if x > p + 1 and x > q + 1:
                            cuts[-1] = f(half(max(p, q)) + 1)
                        elif x < p - 1 and x < q - 1:
                            cuts[-1] = f(half(min(p, q)) - 1)
                        break
        cuts.sort()
        for p, q in zip(cuts[::2], cuts[1::2], strict=False):
            a, b = int(half(p)), int(math.copysign(math.ceil(abs(float(q)) - 0.5), q))
            if b >= max(a, 0):
                out[y, max(a, 0) : b + 1] = True
    return out


def test_polygons_equal_brute_force_in_images_of_any_height():
    rng = random.Random(6)
    for _ in range(400):
        xy = [(rng.randrange(-4, 30), rng.randrange(-4, 30)) for _ in range(rng.randrange(3, 9))]
        spans, final = shapes.polygon_spans(xy)
        for size in (40, 31, 12):
            special = {y for y, _, _ in final if y == size - 1}
            mine = filled([s for s in spans if s[0] not in special] + [s for s in final if s[0] in special], size)
            assert np.array_equal(mine, brute_polygon(xy, size)), (xy, size)


def test_wide_lines_have_their_width():
    for width in range(2, 9):
        assert len({y for y, _, _ in shapes.segment_spans((5, 20), (30, 20), width)[0]}) == width
        assert {b - a + 1 for _, a, b in shapes.segment_spans((20, 5), (20, 30), width)[0]} == {width}
    assert shapes.segment_spans((3, 3), (3, 3), 5)[0] == [(3, 3, 3)]


def test_frames_wider_than_their_box():
    assert filled(shapes.frame_spans((10, 10, 20, 12), 6))[5:20].any(axis=1).nonzero()[0].tolist() == list(range(2, 12))
    assert shapes.frame_spans((5, 5, 4, 9), 1) == []


@pytest.mark.parametrize("literal", [0, 10_000])
def test_many_spans_are_joined(spark, monkeypatch, literal):
    monkeypatch.setattr(draw, "LITERAL_SPANS", literal)
    df = spark.range(1, 3).selectExpr("cast(id as int) image_id", "cast(40 as int) w", "cast(20 + id as int) h").selectExpr("*", "explode(sequence(0, h - 1)) y").selectExpr("*", "explode(sequence(0, 39)) x", "7 b0")
    xy = [(2, 2), (38, 9), (21, 20), (30, 33), (5, 30)]
    out = draw.line(draw.polygon(draw.ellipse(df, (1, 1, 38, 18), [50], [60], 2), xy, [100], [200], 2), [(0, 0), (39, 19)], [250], 3)
    assert out.columns == df.columns
    for k in (1, 2):
        rows = {(r["x"], r["y"]): r["b0"] for r in out.where(f"image_id = {k}").collect()}
        size = 20 + k
        assert len(rows) == 40 * size
        want = np.full((40, 40), 7)
        for spans, value in ((shapes.ellipse_spans((1, 1, 38, 18)), 50), (shapes.ellipse_spans((1, 1, 38, 18), 2), 60)):
            want[filled(spans)] = value
        cover, final = shapes.polygon_spans(xy)
        special = {y for y, _, _ in final if y == size - 1}
        mask = filled([s for s in cover if s[0] not in special] + [s for s in final if s[0] in special])
        want[mask] = 100
        for a, b in zip(xy, xy[1:] + xy[:1], strict=True):
            want[filled(shapes.segment_spans(a, b, 3)[0]) & mask] = 200
        want[filled(shapes.segment_spans((0, 0), (39, 19), 3)[0])] = 250
        got = np.array([[rows[x, y] for x in range(40)] for y in range(size)])
        assert (got != want[:size]).sum() <= 3  # sides that end in an image's last row may differ there

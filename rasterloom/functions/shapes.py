"""Shapes as rows of spans: (y, a, b) covers the places a..b of row y, both ends included.

What a shape covers depends on its parameters alone, so spans are made once, on the driver, a few for each of its rows.
Ellipses and their parts are walked in coordinates that count half pixels from the middle, so that even and odd sizes
have whole numbers.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence

import numpy as np

Point = tuple[float, float]
Span = tuple[int, int, int]
Pieces = list[tuple[int, int]]
#: A region of the plane: what it leaves of a stretch (a, b) of a row.
Region = Callable[[int, int, int], Pieces]
_TINY = 1e-9


def nearest(v: float) -> int:
    """The nearest whole number; halves go away from zero."""
    v = float(v)
    return int(math.copysign(math.floor(abs(v) + 0.5), v))


def _under(v: float) -> int:
    """The nearest whole number; halves go towards zero."""
    return int(math.copysign(math.ceil(abs(v) - 0.5), v)) if abs(v) >= 0.5 else 0


def merged(pieces: Iterable[tuple[int, int]]) -> Pieces:
    """The pieces put together where they touch, in order."""
    out: Pieces = []
    for a, b in sorted(pieces):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


# --- lines and polygons ----------------------------------------------------------------------------------


def line_points(a: Point, b: Point) -> list[tuple[int, int]]:
    """The places of a thin line: one for each step along its longer side."""
    x0, y0, x1, y1 = int(a[0]), int(a[1]), int(b[0]), int(b[1])
    dx, dy = abs(x1 - x0), abs(y1 - y0)
    steep = dy > dx
    if steep:
        x0, y0, x1, y1, dx, dy = y0, x0, y1, x1, dy, dx
    step_u, step_v = (1 if x1 >= x0 else -1), (1 if y1 >= y0 else -1)
    out, error, v = [], 2 * dy - dx, y0
    for k in range(dx + 1):
        u = x0 + k * step_u
        out.append((v, u) if steep else (u, v))
        if error >= 0:
            v += step_v
            error -= 2 * dx
        error += 2 * dy
    return out


class Edge:
    """A slanted or upright side of a polygon. Its places are in single precision."""

    def __init__(self, a: tuple[int, int], b: tuple[int, int]):
        self.x, self.y = np.float32(a[0]), np.float32(a[1])
        self.top, self.bottom = sorted((a[1], b[1]))
        self.slope = np.float32(b[0] - a[0]) / np.float32(b[1] - a[1])

    def at(self, y: int) -> np.float32:
        return (np.float32(y) - self.y) * self.slope + self.x

    def ends(self, y: int) -> bool:
        return y in (self.top, self.bottom) and self.slope != 0


def _corner(edge: Edge, before: Sequence[Edge], y: int) -> np.float32:
    """Where an edge ends: where it and an earlier one end in the same pixel and lean the same way by over a pixel, the end
    is drawn to their next row, so that the corner hangs together."""
    x = edge.at(y)
    to = y - 1 if y == edge.bottom else y + 1
    for other in before:
        if other.ends(y) and nearest(x) == nearest(other.at(y)) and other.top <= to <= other.bottom:
            nexts = edge.at(to), other.at(to)
            if x > nexts[0] + 1 and x > nexts[1] + 1:
                return np.float32(nearest(max(nexts)) + 1)
            if x < nexts[0] - 1 and x < nexts[1] - 1:
                return np.float32(nearest(min(nexts)) - 1)
            return x
    return x


def _sides(xy: Sequence[tuple[int, int]]) -> tuple[list[Edge], list[Span]]:
    """The sides that cross rows, and the level ones as spans."""
    closed = [*xy, xy[0]] if xy[-1] != xy[0] else xy
    sides = list(zip(closed, closed[1:], strict=False))
    return [Edge(a, b) for a, b in sides if a[1] != b[1]], [(a[1], min(a[0], b[0]), max(a[0], b[0])) for a, b in sides if a[1] == b[1]]


def polygon_spans(xy: Sequence[Point]) -> tuple[list[Span], list[Span]]:
    """(spans, spans of rows that are another image's last row). Pairs of crossings are filled, ends included. A side counts
    twice in its last row, but not in the polygon's last row or the image's: rows for which that matters come twice."""
    points = [(int(x), int(y)) for x, y in xy]
    if len(points) < 2:
        return [], []
    edges, levels = _sides(points)
    if not edges:
        return levels, []
    last = max(max(e.bottom for e in edges), max((y for y, _, _ in levels), default=edges[0].bottom))
    by_row: dict[int, list[tuple[int, Edge]]] = defaultdict(list)
    for k, edge in enumerate(edges):
        for y in range(max(edge.top, 0), edge.bottom + 1):
            by_row[y].append((k, edge))

    def row(y: int, final: bool) -> list[Span]:
        cuts: list[np.float32] = []
        for k, edge in by_row[y]:
            if y == edge.bottom and not final:
                cuts += [edge.at(y)] * 2
            else:
                cuts.append(_corner(edge, edges[:k], y) if edge.ends(y) else edge.at(y))
        cuts.sort()
        pairs = ((nearest(a), _under(float(b))) for a, b in zip(cuts[::2], cuts[1::2], strict=False))
        return [(y, a, b) for a, b in pairs if a <= b]

    spans, other = list(levels), []
    for y in sorted(by_row):
        usual = row(y, y >= last)
        spans += usual
        if y < last and any(e.bottom == y for _, e in by_row[y]):
            other += row(y, True) + [s for s in levels if s[0] == y] or [(y, 0, -1)]
    return spans, other


def _met(spans: Iterable[Span], mask: Iterable[Span]) -> list[Span]:
    rows: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for y, a, b in mask:
        rows[y].append((a, b))
    return [(y, max(a, c), min(b, d)) for y, a, b in spans for c, d in merged(p for p in rows.get(y, ()) if p[0] <= p[1]) if max(a, c) <= min(b, d)]


def inside(shape: tuple[list[Span], list[Span]], mask: tuple[list[Span], list[Span]]) -> tuple[list[Span], list[Span]]:
    """What of a shape a mask covers: both with spans of their own for rows that are an image's last."""
    special = {y for part in (shape, mask) for y, _, _ in part[1]}
    final = lambda part: part[1] + [s for s in part[0] if s[0] in special - {y for y, _, _ in part[1]}]
    met = _met(final(shape), final(mask))
    return _met(shape[0], mask[0]), met + [(y, 0, -1) for y in special - {y for y, _, _ in met}]


def wide_line(a: Point, b: Point, width: int) -> list[tuple[int, int]]:
    """The corners of a line of a width over 1. An even width is a pixel wider on one side."""
    (x0, y0), (x1, y1) = ((int(p[0]), int(p[1])) for p in (a, b))
    dx, dy = x1 - x0, y1 - y0
    length = math.sqrt(dx * dx + dy * dy)
    half = (width - 1) / 2
    far, near = nearest(half) / length, _under(half) / length
    left, right, down, up = _under(near * dy), _under(far * dy), _under(far * dx), _under(near * dx)
    return [(x0 - left, y0 + down), (x1 - left, y1 + down), (x1 + right, y1 - up), (x0 + right, y0 - up)]


def segment_spans(a: Point, b: Point, width: int) -> tuple[list[Span], list[Span]]:
    if (int(a[0]), int(a[1])) == (int(b[0]), int(b[1])) or width <= 1:
        return [(y, x, x) for x, y in line_points(a, b)], []
    return polygon_spans(wide_line(a, b, width))


def rectangle_spans(box: Sequence[float]) -> list[Span]:
    x0, y0, x1, y1 = (int(v) for v in box)
    return [(y, x0, x1) for y in range(y0, y1 + 1)] if x1 >= x0 else []


def frame_spans(box: Sequence[float], width: int) -> list[Span]:
    """A rectangle's outline: whole rows from above and from below, then the columns between. A width over half the box's
    height makes the rows pass each other, and the columns fill what they passed."""
    x0, y0, x1, y1 = (int(v) for v in box)
    if x1 < x0 or y1 < y0:
        return []
    rows = {y for k in range(width) for y in (y0 + k, y1 - k)}
    lo, hi = y0 + width, y1 - width + 1
    between = range(lo, hi) if lo < hi else range(hi + 1, lo + 1) if lo > hi else ()
    return [(y, x0, x1) for y in rows] + [(y, a, b) for y in between for a, b in ((x0, x0 + width - 1), (x1 - width + 1, x1))]


# --- ellipses and their parts -------------------------------------------------------------------------------


def quarter(a: int, b: int) -> dict[int, tuple[int, int]]:
    """row -> (outermost, innermost) place of the quarter of an ellipse of the diameters a and b, walked from the side to
    the top: up, then aslant, then inwards, whichever stays nearest to the curve (the first of equals)."""
    if a < 0 or b < 0:
        return {}
    off = lambda p: abs(a * a * p[1] * p[1] + b * b * p[0] * p[0] - a * a * b * b)
    at, top, rows = (a, b % 2), (a % 2, b), {}
    while True:
        x, y = at
        rows[y] = rows.get(y, at)[0], x
        if at == top:
            return rows
        at = min([(x, y + 2), (x - 2, y + 2), (x - 2, y)] if x > 1 else [(x, y + 2)], key=off)


def ring(a: int, b: int, width: int) -> list[Span]:
    """The half-pixel spans of the outer ``width`` pixels of an ellipse of the diameters a and b."""
    if width < 1 or a < 0 or b < 0:
        return []
    inner = quarter(a - 2 * (width - 1), b - 2 * (width - 1))
    out: list[Span] = []
    for y, (right, _) in quarter(a, b).items():
        left = inner[y][1] if y in inner else a % 2
        for v in {y, -y}:
            out.append((v, -right, -left))
            if left > 0 or left < right:
                out.append((v, left or 2, right))
    return out


def half_plane(a: float, b: float, c: float) -> Region:
    """Where a*x + b*y + c is not under zero."""

    def cut(y: int, x0: int, x1: int) -> Pieces:
        level = b * y + c
        if abs(a) < _TINY:
            return [] if level < -_TINY else [(x0, x1)]
        if a * x0 + level < _TINY:
            x0 = nearest(max(x0, -level / a))
        if a * x1 + level < _TINY:
            x1 = nearest(min(x1, -level / a))
        return [(x0, x1)] if x0 <= x1 else []

    return cut


def both(p: Region, q: Region) -> Region:
    meet = lambda y, a, b: ((max(s, u), min(t, v)) for s, t in p(y, a, b) for u, v in q(y, a, b))
    return lambda y, a, b: merged((s, t) for s, t in meet(y, a, b) if s <= t)


def either(p: Region, q: Region) -> Region:
    return lambda y, a, b: merged(p(y, a, b) + q(y, a, b))


def turned(start: float, end: float) -> tuple[np.float32, np.float32]:
    """Degrees in single precision, start from 0 to 360 and end up to 360 more; a whole turn is (0, 360)."""
    one = np.float32
    start, end = one(start), one(end)
    if end - start >= 360:
        return one(0), one(360)
    start = (one(360) - np.fmod(-start, one(360)) if start < 0 else start) % one(360)
    sweep = one(360) - np.fmod(start - end, one(360)) if end < start else np.fmod(end - start, one(360))
    return start, start + sweep


def _on_curve(a: int, b: int, angle: float) -> tuple[float, float]:
    turn = math.radians(float(angle))
    return a * math.cos(turn), b * math.sin(turn)


def arc_region(a: int, b: int, start: np.float32, end: np.float32, plane: Callable[[float, float, float], Region] = half_plane) -> Region | None:
    """What is between the curve's normals at two angles. Upright ellipses are lying ones, with x and y exchanged."""
    if a < b:
        return arc_region(b, a, np.float32(90) - end, np.float32(90) - start, lambda p, q, c: half_plane(q, p, c))
    start, end = turned(start, end)
    if end == start + np.float32(360):
        return None
    spread = float(a * a - b * b)
    tilt = lambda t: spread * math.sin(float(t) * math.pi / 90) / 2
    s, e = math.radians(float(start)), math.radians(float(end))
    first = plane(-a * math.sin(s), b * math.cos(s), tilt(start))
    second = plane(a * math.sin(e), -b * math.cos(e), -tilt(end))
    joined = both if end - start < 180 else either
    half = lambda below: plane(0.0, 1.0 if below else -1.0, 0.0)
    turns = int(start / 180), int(end / 180)
    if start % 180 == 0 or end % 180 == 0:
        return joined(first, second)
    if sum(turns) % 2:
        return either(both(half(turns[0] % 2 == 0), first), both(half(turns[1] % 2 == 0), second))
    return joined(joined(first, second), half(end < 180 or end > 540))


def chord_region(a: int, b: int, start: float, end: float, width: int | None = None) -> Region:
    """Beyond the line between two points of the curve, and no more than ``width`` pixels of it."""
    (x0, y0), (x1, y1) = _on_curve(a, b, start), _on_curve(a, b, end)
    p, q = y1 - y0, x0 - x1
    c = -(p * x0 + q * y0)
    beyond = half_plane(p, q, c)
    return beyond if width is None else both(beyond, half_plane(-p, -q, 2.0 * width * math.sqrt(p * p + q * q) - c))


def slice_region(a: int, b: int, start: np.float32, end: np.float32) -> Region:
    (x0, y0), (x1, y1) = _on_curve(a, b, start), _on_curve(a, b, end)
    joined = both if end - start < 180 else either
    region = joined(half_plane(-y0, x0, 0.0), half_plane(y1, -x1, 0.0))
    return both(region, half_plane((x0 + x1) / 2, (y0 + y1) / 2, 0.0)) if end - start < 90 else region


def radius_region(a: int, b: int, angle: float, width: int) -> Region:
    """A stroke from the middle towards the curve's point at an angle."""
    x, y = _on_curve(a, b, angle)
    reach = width * math.sqrt(x * x + y * y)
    return both(both(half_plane(-y, x, reach), half_plane(y, -x, reach)), half_plane(x, y, 0.0))


def ellipse_spans(box: Sequence[float], width: int | None = None, region: Region | None = None) -> list[Span]:
    """Spans of the ellipse in a box whose corners are part of it: its outer ``width`` pixels (None: all, but nothing of a
    single pixel), and of those what the region leaves."""
    x0, y0, x1, y1 = (int(v) for v in box)
    a, b = x1 - x0, y1 - y0
    keep = region or (lambda y, p, q: [(p, q)])
    spans = ((y, s, t) for y, p, q in ring(a, b, a + b if width is None else width) for s, t in keep(y, p, q))
    return [(y0 + (y + b) // 2, x0 + (p + a) // 2, x0 + (q + a) // 2) for y, p, q in spans]

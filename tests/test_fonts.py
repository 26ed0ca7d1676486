"""Bitmap fonts: files that are wrong, boxes that reach out, layout, against placing glyph by glyph."""

import struct

import numpy as np
import pytest

from rasterloom.operators import fonts as FO
from rasterloom.queries import font_file

STRIP = np.random.default_rng(3).integers(0, 256, (30, 40))


def record(c):
    boxes = {97: [4, 0, 0, -5, 4, 0, 3, 2, 7, 7], 98: [3, 1, -1, -6, 5, -1, -2, 10, 4, 15], 99: [5, -1, 0, -4, 4, 2, 36, 26, 42, 33], 100: [2, 0, 0, 0, 3, 3, 0, 0, 4, 4], 233: [6, 0, 1, -3, 5, 0, 20, 20, 24, 23]}
    return boxes.get(c, [0] * 10)


def font(spark):
    raw = spark.createDataFrame([(7, bytearray(font_file(record, "Courier\nsize 8\n")))], "font_id int, content binary")
    rows = [(7, 40, 30, x, y, int(STRIP[y, x])) for y in range(30) for x in range(40)]
    strip = spark.createDataFrame(rows, "image_id int, w int, h int, x int, y int, b0 int")
    glyphs = FO.font_glyphs(raw, strip)
    return raw, glyphs, FO.font_strokes(glyphs, strip)


def placed(text):
    """The mask of a line, glyph by glyph."""
    cut = {}
    for c in range(256):
        dx, dy, x0, y0, x1, y1, sx0, sy0, sx1, sy1 = record(c)
        x0, sx0 = x0 + max(0, -sx0), max(0, sx0)
        y0, sy0 = y0 + max(0, -sy0), max(0, sy0)
        x1, sx1 = x1 - max(0, sx1 - 40), min(40, sx1)
        y1, sy1 = y1 - max(0, sy1 - 30), min(30, sy1)
        cut[c] = dx, dy, x0, y0, x1, y1, sx0, sy0, sx1, sy1
    top, bottom = min(g[3] for g in cut.values()), max(g[5] for g in cut.values())
    codes = text.split("\0")[0].encode("latin-1")
    out = np.zeros((bottom - top, sum(cut[c][0] for c in codes)), int)
    x, y = 0, -top
    for c in codes:
        dx, dy, x0, y0, x1, y1, sx0, sy0, sx1, sy1 = cut[c]
        if (x1 - x0, y1 - y0) == (sx1 - sx0, sy1 - sy0):
            for v in range(sy0, sy1):
                for u in range(sx0, sx1):
                    px, py = x + x0 + u - sx0, y + y0 + v - sy0
                    if 0 <= px < out.shape[1] and 0 <= py < out.shape[0]:
                        out[py, px] = STRIP[v, u]
        x, y = x + dx, y + dy
    return out


TEXTS = ["abc", "", "aabbcc\0aaa", "ébdbé", "zzz", "ccccc", "bbbb"]


@pytest.mark.parametrize("orientation,turn", [(None, lambda m: m), ("ROTATE_90", np.rot90), ("FLIP_LEFT_RIGHT", np.fliplr)])
def test_masks_equal_placing_glyph_by_glyph(spark, orientation, turn):
    _, glyphs, strokes = font(spark)
    words = spark.createDataFrame([(k, 7, t) for k, t in enumerate(TEXTS)], "image_id int, font_id int, text string")
    got = {}
    for r in FO.text_mask(words, glyphs, strokes, orientation).collect():
        got.setdefault(r["image_id"], np.full((r["h"], r["w"]), -1))[r["y"], r["x"]] = r["b0"]
    for k, t in enumerate(TEXTS):
        want = turn(placed(t))
        assert (k not in got and want.size == 0) or np.array_equal(got[k], want), t
    sizes = {r["image_id"]: (r["right"], r["lower"]) for r in FO.text_size(words, glyphs, orientation).collect()}
    assert sizes == {k: turn(placed(t)).shape[::-1] for k, t in enumerate(TEXTS)}


def test_multiline_text_with_empty_lines(spark):
    _, glyphs, strokes = font(spark)
    height = placed("a").shape[0]
    words = spark.createDataFrame([(1, 7, "a\n\nabc\nb"), (2, 7, ""), (3, 7, "\n\n")], "image_id int, font_id int, text string")
    lines = sorted(map(tuple, FO.lines_of(words, glyphs, 3, "center", "rd").where("image_id = 1").select("line", "width", "left", "top").collect()))
    depth = (height + 3) + 13 + (height + 3) + height
    assert lines == [(0, 4, 4 - 12, -depth), (1, 0, 6 - 12, height + 3 - depth), (2, 12, -12, height + 16 - depth), (3, 3, 4 - 12, 2 * height + 19 - depth)]
    boxes = FO.multiline_box(words, glyphs, 3, "center", "rd").collect()
    assert [tuple(b) for b in boxes] == [(1, -12, -depth, 0, 0)]
    assert FO.line_pixels(FO.lines_of(words.limit(0), glyphs), glyphs, strokes).collect() == []


def test_files_that_are_no_fonts(spark):
    good = font_file(record, "a line\nDATA is not this\n")
    rows = [(1, good), (2, b"other"), (3, good[:-1]), (4, b"PILfont\n;\nno end\n"), (5, None), (6, b"")]
    df = spark.createDataFrame([(k, v and bytearray(v)) for k, v in rows], "font_id int, content binary")
    assert {r["font_id"]: r["error"] for r in FO.font_errors(df).collect()} == {
        2: "Not a PILfont file", 3: "descriptor table has wrong size", 4: "descriptor table has wrong size", 5: "Not a PILfont file", 6: "Not a PILfont file"}
    assert [r["info"] for r in FO.font_info(df.where("font_id = 1")).collect()] == [["a line", "DATA is not this"]]
    strip = spark.createDataFrame([(k, 1, 1, 0, 0, 5) for k in range(1, 7)], "image_id int, w int, h int, x int, y int, b0 int")
    found = FO.font_glyphs(df, strip).collect()
    assert len(found) == 256 and {r["font_id"] for r in found} == {1} and struct.unpack(">h", good[-20:-18])[0] == 0


def test_what_fonts_refuse(spark):
    _, glyphs, strokes = font(spark)
    words = spark.createDataFrame([(1, 7, "a€")], "image_id int, font_id int, text string")
    with pytest.raises(Exception, match="Latin-1"):
        FO.text_mask(words, glyphs, strokes).collect()
    for call in (lambda: FO.text_advance(words, glyphs, "ROTATE_90"), lambda: FO.lines_of(words, glyphs, align="middle"), lambda: FO.lines_of(words, glyphs, anchor="xx")):
        with pytest.raises(ValueError):
            call()

"""Colour strings to components, as column functions: names, #-forms, rgb(), rgba(), hsl() and hsv()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .samples import luma

#: The named colours of CSS.
NAMES = """
aliceblue #f0f8ff antiquewhite #faebd7 aqua #00ffff aquamarine #7fffd4 azure #f0ffff beige #f5f5dc bisque #ffe4c4 black #000000
blanchedalmond #ffebcd blue #0000ff blueviolet #8a2be2 brown #a52a2a burlywood #deb887 cadetblue #5f9ea0 chartreuse #7fff00
chocolate #d2691e coral #ff7f50 cornflowerblue #6495ed cornsilk #fff8dc crimson #dc143c cyan #00ffff darkblue #00008b darkcyan #008b8b
darkgoldenrod #b8860b darkgray #a9a9a9 darkgreen #006400 darkgrey #a9a9a9 darkkhaki #bdb76b darkmagenta #8b008b darkolivegreen #556b2f
darkorange #ff8c00 darkorchid #9932cc darkred #8b0000 darksalmon #e9967a darkseagreen #8fbc8f darkslateblue #483d8b darkslategray #2f4f4f
darkslategrey #2f4f4f darkturquoise #00ced1 darkviolet #9400d3 deeppink #ff1493 deepskyblue #00bfff dimgray #696969 dimgrey #696969
dodgerblue #1e90ff firebrick #b22222 floralwhite #fffaf0 forestgreen #228b22 fuchsia #ff00ff gainsboro #dcdcdc ghostwhite #f8f8ff
gold #ffd700 goldenrod #daa520 gray #808080 green #008000 greenyellow #adff2f grey #808080 honeydew #f0fff0 hotpink #ff69b4
indianred #cd5c5c indigo #4b0082 ivory #fffff0 khaki #f0e68c lavender #e6e6fa lavenderblush #fff0f5 lawngreen #7cfc00 lemonchiffon #fffacd
lightblue #add8e6 lightcoral #f08080 lightcyan #e0ffff lightgoldenrodyellow #fafad2 lightgray #d3d3d3 lightgreen #90ee90 lightgrey #d3d3d3
lightpink #ffb6c1 lightsalmon #ffa07a lightseagreen #20b2aa lightskyblue #87cefa lightslategray #778899 lightslategrey #778899
lightsteelblue #b0c4de lightyellow #ffffe0 lime #00ff00 limegreen #32cd32 linen #faf0e6 magenta #ff00ff maroon #800000
mediumaquamarine #66cdaa mediumblue #0000cd mediumorchid #ba55d3 mediumpurple #9370db mediumseagreen #3cb371 mediumslateblue #7b68ee
mediumspringgreen #00fa9a mediumturquoise #48d1cc mediumvioletred #c71585 midnightblue #191970 mintcream #f5fffa mistyrose #ffe4e1
moccasin #ffe4b5 navajowhite #ffdead navy #000080 oldlace #fdf5e6 olive #808000 olivedrab #6b8e23 orange #ffa500 orangered #ff4500
orchid #da70d6 palegoldenrod #eee8aa palegreen #98fb98 paleturquoise #afeeee palevioletred #db7093 papayawhip #ffefd5 peachpuff #ffdab9
peru #cd853f pink #ffc0cb plum #dda0dd powderblue #b0e0e6 purple #800080 rebeccapurple #663399 red #ff0000 rosybrown #bc8f8f
royalblue #4169e1 saddlebrown #8b4513 salmon #fa8072 sandybrown #f4a460 seagreen #2e8b57 seashell #fff5ee sienna #a0522d silver #c0c0c0
skyblue #87ceeb slateblue #6a5acd slategray #708090 slategrey #708090 snow #fffafa springgreen #00ff7f steelblue #4682b4 tan #d2b48c
teal #008080 thistle #d8bfd8 tomato #ff6347 turquoise #40e0d0 violet #ee82ee wheat #f5deb3 white #ffffff whitesmoke #f5f5f5
yellow #ffff00 yellowgreen #9acd32
"""


def _names() -> Column:
    words = NAMES.split()
    return F.create_map(*map(F.lit, words))


def _hexes(c: Column) -> Column:
    """struct(r, g, b, a) of #rgb, #rgba, #rrggbb or #rrggbbaa; else null."""
    short = c.rlike("^#[0-9a-f]{3,4}$")
    digits = F.when(short, F.regexp_replace(c, "([0-9a-f])", "$1$1")).when(c.rlike("^#(?:[0-9a-f]{6}|[0-9a-f]{8})$"), c)
    part = lambda k: F.conv(F.substring(digits, 2 + 2 * k, 2), 16, 10).cast("int")
    return F.when(digits.isNotNull(), F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"), F.when(F.length(digits) == 9, part(3)).otherwise(255).alias("a")))


def _turned(c: Column) -> Column:
    """struct(r, g, b, a) of hsl(h, s%, l%) and hsv(h, s%, v%); else null."""
    pattern = r"^(hsl|hsv|hsb)\(\s*(\d+\.?\d*)\s*,\s*(\d+\.?\d*)%\s*,\s*(\d+\.?\d*)%\s*\)$"
    number = lambda k: F.regexp_extract(c, pattern, k).try_cast("double")
    h, s, l = F.pmod(number(2), F.lit(360.0)), number(3) / 100.0, number(4) / 100.0  # noqa: E741
    value = F.regexp_extract(c, pattern, 1) != "hsl"
    top = F.when(value, l).otherwise(l + s * F.least(l, 1.0 - l))
    low = F.when(value, l * (1.0 - s)).otherwise(2.0 * l - top)

    def channel(turn: float) -> Column:
        k = F.pmod(h / 60.0 + turn, F.lit(6.0))
        return F.floor((top - (top - low) * F.greatest(F.lit(0.0), F.least(k, 4.0 - k, F.lit(1.0)))) * 255.0 + 0.5).cast("int")

    return F.when(c.rlike(pattern), F.struct(channel(5.0).alias("r"), channel(3.0).alias("g"), channel(1.0).alias("b"), F.lit(255).alias("a")))


def getrgb(text: Column) -> Column:
    """struct(r, g, b, a) of a colour string; null if it is none. rgb() and rgba() are not bounded; their
    percentages are rounded half up."""
    c = F.lower(text)
    whole = r"^rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)$"
    share = r"^rgb\(\s*(\d+)%\s*,\s*(\d+)%\s*,\s*(\d+)%\s*\)$"
    with_alpha = r"^rgba\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)$"
    number = lambda pattern, k: F.regexp_extract(c, pattern, k).try_cast("int")
    percent = lambda k: F.floor(number(share, k) * 255 / 100.0 + 0.5).cast("int")
    of = lambda r, g, b, a: F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))
    return F.when(F.length(text) > 100, None).otherwise(F.coalesce(
        _hexes(c),
        _hexes(F.try_element_at(_names(), c)),
        F.when(c.rlike(whole), of(*(number(whole, k) for k in (1, 2, 3)), F.lit(255))),
        F.when(c.rlike(share), of(*(percent(k) for k in (1, 2, 3)), F.lit(255))),
        F.when(c.rlike(with_alpha), of(*(number(with_alpha, k) for k in (1, 2, 3, 4)))),
        _turned(c),
    ))


def _hsv(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """Hue, saturation and value, each cut to a whole number of 255ths."""
    r, g, b = (v / 255.0 for v in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    away = lambda v: (top - v) / F.nullif(top - low, F.lit(0.0))
    sixth = F.when(r == top, away(b) - away(g)).when(g == top, 2.0 + away(r) - away(b)).otherwise(4.0 + away(g) - away(r))
    whole = lambda v: F.coalesce((v * 255.0).cast("int"), F.lit(0))
    return whole(F.pmod(sixth / 6.0, F.lit(1.0))), whole((top - low) / F.nullif(top, F.lit(0.0))), whole(top)


def getcolor(text: Column, mode: str) -> Column:
    """An array of the colour's components in the mode, from the unbounded rgb."""
    c = getrgb(text)
    if mode in ("L", "1", "I", "F", "I;16"):
        return F.array(luma(c["r"], c["g"], c["b"]))
    if mode == "HSV":
        return F.array(*_hsv(c["r"], c["g"], c["b"]))
    if mode == "LA":
        return F.array(luma(c["r"], c["g"], c["b"]), c["a"])
    return F.array(c["r"], c["g"], c["b"], *([c["a"]] if mode.endswith("A") else []))

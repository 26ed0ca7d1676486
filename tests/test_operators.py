"""Operators without SQL, and what the queries do not reach, against plain Python and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import shapes
from rasterloom.functions.colors import getcolor, getrgb
from rasterloom.operators import binary, color, draw, equalization, geometry, neighborhood, point, procedural, reductions, resample
from rasterloom.plans.chain import Chain, compose_transposes
from rasterloom.relation import KEYS, bands
from rasterloom.sources import files, pixels
from rasterloom.streaming import frames


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(1)
    return {1: rng.integers(0, 256, (7, 9, 4)), 2: rng.integers(0, 256, (12, 5, 4)), 3: np.zeros((1, 1, 4), int)}


def relation(spark, images, n):
    rows = [(i, a.shape[1], a.shape[0], x, y, *map(int, a[y, x, :n])) for i, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id bigint, w int, h int, x int, y int, " + ", ".join(f"b{k} int" for k in range(n)))


def arrays(df):
    out = {}
    own = bands(df)
    for r in df.collect():
        out.setdefault(r["image_id"], np.full((r["h"], r["w"], len(own)), -1))[r["y"], r["x"]] = [r[b] for b in own]
    return out


def equal(found, wanted):
    assert found.keys() == wanted.keys()
    for k, a in wanted.items():
        assert np.array_equal(found[k], a), (k, found[k][..., 0], a[..., 0])


def test_transposes_are_numpy_s(spark, images):
    df = relation(spark, images, 3)
    flips = {"ROTATE_90": lambda a: np.rot90(a), "ROTATE_180": lambda a: np.rot90(a, 2), "ROTATE_270": lambda a: np.rot90(a, 3), "FLIP_LEFT_RIGHT": lambda a: a[:, ::-1],
             "FLIP_TOP_BOTTOM": lambda a: a[::-1], "TRANSPOSE": lambda a: a.transpose(1, 0, 2), "TRANSVERSE": lambda a: np.rot90(a, 2).transpose(1, 0, 2)}
    for method, fn in flips.items():
        equal(arrays(geometry.transpose(df, method)), {k: fn(a[..., :3]) for k, a in images.items()})


def test_composed_transposes(spark, images):
    df = relation(spark, images, 1)
    for a in geometry.TRANSPOSES:
        for b in geometry.TRANSPOSES:
            both = compose_transposes(a, b)
            wanted = geometry.TRANSPOSES[b](*geometry.TRANSPOSES[a](1, 0, 4, 3))
            assert wanted == (geometry.TRANSPOSES[both](1, 0, 4, 3) if both else (1, 0, 4, 3))
    chain = Chain(df).mirror().mirror()
    assert chain.steps == () and len(Chain(df).invert().posterize(2).flip().mirror().steps) == 2


def test_palette_images_stay_indices_while_they_can(spark, images):
    df = relation(spark, images, 1)
    palette = color.put_palette(df.select("image_id").distinct(), [(v, 255 - v, 7) for v in range(256)])
    chain = Chain(df, "P", palette).mirror().crop((0, 0, 1, 1))
    assert bands(chain.frame()) == ["b0"]
    found = arrays(chain.convert("RGB").frame())
    for k, a in images.items():
        v = a[0, -1, 0]
        assert found[k][0, 0].tolist() == [v, 255 - v, 7]
    assert len(bands(chain.invert().frame())) == 3
    assert color.palette_color(palette, (9, 246, 7)).first()["idx"] == 9
    assert color.get_palette(palette, "BGR").first()["palette"][:6] == [7, 255, 0, 7, 254, 1]


def lanczos(x):
    return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3) if abs(x) < 3 else 0.0


def resized(line, out, kernel, support):
    scale = len(line) / out
    stretch, res = max(scale, 1.0), []
    for o in range(out):
        centre = (o + 0.5) * scale
        lo, hi = max(0, int(centre - support * stretch + 0.5)), min(len(line), int(centre + support * stretch + 0.5))
        k = np.array([kernel((s + 0.5 - centre) / stretch) for s in range(lo, hi)])
        wt = [int(v * (1 << 22) + (0.5 if v >= 0 else -0.5)) for v in k / k.sum()]
        res.append(min(255, max(0, (sum(int(v) * t for v, t in zip(line[lo:hi], wt, strict=True)) + (1 << 21)) >> 22)))
    return np.array(res)


def test_resize_of_images_of_different_sizes(spark, images):
    wanted = {}
    for k, a in images.items():
        rows = np.stack([np.stack([resized(a[y, :, b], 4, lanczos, 3.0) for b in range(3)], axis=-1) for y in range(a.shape[0])])
        wanted[k] = np.stack([np.stack([resized(rows[:, x, b], 6, lanczos, 3.0) for b in range(3)], axis=-1) for x in range(4)], axis=1)
    equal(arrays(resample.resize(relation(spark, images, 3), (4, 6), "LANCZOS")), wanted)


def test_alpha_weights_samples(spark):
    img = {1: np.array([[[200, 10, 90, 255], [255, 255, 255, 0]], [[200, 10, 90, 255], [255, 255, 255, 0]]])}
    found = arrays(resample.resize(relation(spark, img, 4), (1, 1), "BOX", alpha=True))[1][0, 0]
    assert found[3] == 128 and abs(found[:3] - np.array([200, 10, 90])).max() <= 1


def test_sizes_of_thumbnails_and_fits(spark):
    img = {1: np.zeros((20, 32, 1), int), 2: np.zeros((8, 8, 1), int), 3: np.zeros((50, 10, 1), int)}
    df = relation(spark, img, 1)
    size = lambda out: {r["image_id"]: (r["w"], r["h"]) for r in out.select("image_id", "w", "h").distinct().collect()}
    assert size(resample.thumbnail(df, (12, 12))) == {1: (12, 8), 2: (8, 8), 3: (2, 12)}
    assert size(resample.contain(df, (20, 10))) == {1: (16, 10), 2: (10, 10), 3: (2, 10)}
    assert size(resample.cover(df, (20, 10))) == {1: (20, 12), 2: (20, 20), 3: (20, 100)}
    assert set(size(resample.fit(df, (6, 4))).values()) == set(size(resample.pad(df, (6, 4), [9])).values()) == {(6, 4)}
    assert size(resample.scale(df, 0.5)) == {1: (16, 10), 2: (4, 4), 3: (5, 25)}


def test_rotation(spark, images):
    df = relation(spark, images, 1)
    equal(arrays(resample.rotate(df, 90, expand=True)), {k: np.rot90(a[..., :1]) for k, a in images.items()})
    equal(arrays(resample.rotate(df, 360)), {k: a[..., :1] for k, a in images.items()})
    wanted = {}
    for k, a in images.items():
        h, w = a.shape[:2]
        c, s = round(math.cos(-math.radians(33)), 15), round(math.sin(-math.radians(33)), 15)
        fix = lambda v: math.floor(v * 65536 + 0.5)
        cx, cy = -w / 2 * c - h / 2 * s + w / 2, w / 2 * s - h / 2 * c + h / 2
        out = np.full((h, w, 1), 5)
        for y in range(h):
            for x in range(w):
                p = (x * fix(c) + y * fix(s) + fix(cx + c * 0.5 + s * 0.5)) >> 16
                q = (x * fix(-s) + y * fix(c) + fix(cy - s * 0.5 + c * 0.5)) >> 16
                if 0 <= p < w and 0 <= q < h:
                    out[y, x] = a[q, p, :1]
        wanted[k] = out
    equal(arrays(resample.rotate(df, 33, fill=[5])), wanted)
    grown = resample.rotate(df, 45, "BILINEAR", expand=True).where("image_id = 1").first()
    assert grown["w"] == grown["h"] == 13


def test_windows_on_images_of_one_pixel(spark, images):
    df = relation(spark, images, 1)
    for fn in (neighborhood.median_filter, neighborhood.min_filter, neighborhood.mode_filter, lambda d: neighborhood.gaussian_blur(d, 2), lambda d: neighborhood.named_filter(d, "BLUR")):
        assert arrays(fn(df))[3].tolist() == [[[0]]]
    with pytest.raises(ValueError):
        neighborhood.box_blur(df, 1.5)
    with pytest.raises(ValueError):
        neighborhood.kernel_filter(df, [1, 2, 3])


def test_colour_round_trips(spark):
    df = spark.range(4096).select(F.col("id").alias("image_id"), F.lit(1).alias("w"), F.lit(1).alias("h"), F.lit(0).alias("x"), F.lit(0).alias("y"),
                                  *((F.floor(F.col("id") / 16**k) % 16 * 17).cast("int").alias(f"b{k}") for k in range(3)))
    for mode, far in (("YCbCr", 3), ("HSV", 8), ("CMYK", 0)):
        back = color.convert(color.convert(df, "RGB", mode), mode, "RGB").select("image_id", *(F.col(f"b{k}").alias(f"c{k}") for k in range(3)))
        gap = df.join(back, "image_id").agg(F.max(F.greatest(*(F.abs(F.col(f"b{k}") - F.col(f"c{k}")) for k in range(3))))).first()[0]
        assert gap <= far, mode


def test_colour_strings(spark):
    wanted = {"red": (255, 0, 0, 255), "#0F0": (0, 255, 0, 255), "#12345678": (18, 52, 86, 120), "rgb(300, 0,0)": (300, 0, 0, 255), "rgb(50%,0%,100%)": (128, 0, 255, 255), "rgba(1,2,3,4)": (1, 2, 3, 4),
              "hsl(120, 100%, 50%)": (0, 255, 0, 255), "hsv(240,100%,100%)": (0, 0, 255, 255), "RebeccaPurple": (102, 51, 153, 255), "bad": None, "rgb(1,2)": None, "hsla(1,2%,3%,1)": None, " red": None, "": None, "#12": None, None: None}
    df = spark.createDataFrame([(k,) for k in wanted], "s string")
    for r in df.select("s", getrgb(F.col("s")).alias("c"), getcolor(F.col("s"), "L").alias("l")).collect():
        assert (tuple(r["c"]) if r["c"] else None) == wanted[r["s"]], r["s"]
    assert df.where("s = 'red'").select(getcolor(F.col("s"), "L")).first()[0] == [76]


def test_bytes(spark, images):
    one = {k: np.where(a[..., :1] > 99, 255, 0) for k, a in images.items() if k != 3}
    packed = {r["image_id"]: bytes(r["data"]) for r in pixels.to_bytes(relation(spark, one, 1), "1").collect()}
    assert packed == {k: np.packbits(a[..., 0] > 0, axis=1).tobytes() for k, a in one.items()}
    df = spark.createDataFrame([(1, bytearray(packed[1]))], "image_id bigint, data binary")
    equal(arrays(pixels.from_bytes(df, "data", "1", (9, 7))), {1: one[1]})
    whole = np.array([[-5, 70000], [2**31 - 1, -(2**31)]])
    ints = spark.createDataFrame([(1, bytearray(whole.astype("<i4").tobytes()))], "image_id bigint, data binary")
    found = pixels.from_bytes(ints, "data", "I", (2, 2))
    assert np.array_equal(arrays(found)[1][..., 0], whole)
    assert bytes(pixels.to_bytes(found, "I").first()["data"]) == whole.astype("<i4").tobytes()
    with pytest.raises(Exception, match="not enough image data"):
        pixels.from_bytes(ints, "data", "L", (2, 2)).collect()
    assert "0x" in pixels.to_bitmap(relation(spark, one, 1)).first()["source"]


def test_codecs():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4):
        a = rng.integers(0, 256, 6 * 5 * n)
        w, h, k, back = files.decode_png(files.encode_png(6, 5, n, a))
        assert (w, h, k) == (6, 5, n) and np.array_equal(back, a)
        if n > 2:
            assert np.array_equal(files.decode_bmp(files.encode_bmp(6, 5, n, a))[3], a)
    with pytest.raises(ValueError):
        files.decode_png(files.encode_png(2, 2, 1, np.zeros(4))[:-8] + b"12345678")


def test_files(spark, images, tmp_path):
    for r in files.encode(relation(spark, images, 3), "PNG").collect():
        (tmp_path / f"{r['image_id']}.png").write_bytes(bytes(r["content"]))
    (tmp_path / "bad.bmp").write_bytes(b"BM nothing")
    (tmp_path / "x.txt").write_text("text")
    found = files.open_images(spark, str(tmp_path))
    assert sorted((r["format"], r["width"]) for r in found.where("format = 'PNG'").collect()) == [("PNG", 1), ("PNG", 5), ("PNG", 9)]
    assert {(r["format"], r["ok"]) for r in files.verify(found).collect()} == {("PNG", True), ("BMP", False)}
    assert files.open_images(spark, str(tmp_path), ["BMP"]).count() == 1
    sums = {a.shape[:2]: a[..., :3].sum() for a in images.values()}
    for r in files.load_pixels(found, "RGB").groupBy("h", "w").agg(F.sum(F.col("b0") + F.col("b1") + F.col("b2")).alias("s")).collect():
        assert sums[r["h"], r["w"]] == r["s"]


def test_dither_and_noise(spark, images):
    img = {1: np.full((16, 16, 1), 64), 2: np.full((4, 4, 1), 255)}
    out = arrays(procedural.dither(relation(spark, img, 1)))
    assert set(np.unique(out[1])) == {0, 255} and abs(out[1].mean() - 64) < 12 and (out[2] == 255).all()
    assert procedural.noise(4, 0.0) == [128] * 4 and abs(np.mean(procedural.noise(4000, 20)) - 128) < 2
    spread = arrays(procedural.effect_spread(relation(spark, images, 1), 3))
    assert all(set(spread[k].ravel()) <= set(a[..., 0].ravel()) for k, a in images.items())


def brute_octree(img, colors):
    """The rules of the fast octree over dictionaries of cubes."""
    n_bands = img.shape[2]
    fine, coarse = ((4, 4, 4), (2, 2, 2)) if n_bands == 3 else ((3, 4, 3, 3), (2, 2, 2, 2))
    rows = [list(map(int, p)) for p in img.reshape(-1, n_bands)]
    clear = next((p[:3] for p in rows if n_bands == 4 and p[3] == 0), None)
    rows = [[*clear, 0] if n_bands == 4 and p[3] == 0 else p for p in rows]
    place = lambda p, bits: tuple(v >> (8 - n) for v, n in zip(p, bits))
    cubes = {bits: {} for bits in (fine, coarse)}
    for bits, own in cubes.items():
        for p in rows:
            own.setdefault(place(p, bits), []).append(p)
    mean = lambda ps: [sum(c) // len(ps) for c in zip(*ps)]
    fullest = sorted(cubes[fine], key=lambda c: (-len(cubes[fine][c]), c))
    n_coarse = min(colors, len(cubes[coarse]))
    while True:
        gone = set(fullest[: colors - n_coarse])
        left = {c: kept for c, ps in cubes[coarse].items() if (kept := [p for p in ps if place(p, fine) not in gone])}
        if n_coarse <= len(left):
            break
        n_coarse = len(left)
    entries = sorted(left, key=lambda c: (-len(left[c]), c))[:n_coarse]
    palette = [mean(left[c]) for c in entries] + [mean(cubes[fine][c]) for c in fullest[: colors - n_coarse]]
    palette += [[0] * n_bands] * (colors - len(palette))
    index = [n_coarse + fullest.index(place(p, fine)) if place(p, fine) in gone else entries.index(place(p, coarse)) if place(p, coarse) in entries else 0 for p in rows]
    return index, palette


@pytest.mark.parametrize("colors,n_bands", [(3, 3), (16, 3), (200, 3), (16, 4), (90, 4)])
def test_quantize_by_octree(spark, colors, n_bands):
    rng = np.random.default_rng(colors)
    images = {k: rng.integers(0, 256, (9, 12, n_bands)) for k in (1, 2)} | {3: rng.integers(0, 40, (6, 5, n_bands)) * 6, 4: np.full((3, 3, n_bands), 77)}
    if n_bands == 4:
        for a in images.values():
            a[::2, ::3, 3] = 0
    found, palette = procedural.quantize(relation(spark, images, n_bands), colors, 2, 1)
    got, tables = arrays(found), {}
    for r in palette.collect():
        tables.setdefault(r["image_id"], {})[r["idx"]] = list(r[2:])
    for k, a in images.items():
        index, wanted = brute_octree(a, colors)
        assert got[k].ravel().tolist() == index
        assert [tables[k][i] for i in range(colors)] == wanted


def brute_diffused(img, choose):
    """Error diffusion with the errors of all pixels in one table."""
    h, w, n = img.shape
    carried, out = np.zeros((h + 1, w + 2, n), int), np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            v = np.array([min(255, max(0, int(img[y, x, c]) + int(carried[y, x + 1, c] / 16))) for c in range(n)])
            out[y, x], level = choose(v)
            for dy, dx, share in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                carried[y + dy, x + 1 + dx] += share * (v - level)
    return out


def test_serial_operators_exactly(spark):
    rng = np.random.default_rng(4)
    images = {1: rng.integers(0, 256, (7, 9, 3)), 2: rng.integers(0, 256, (5, 4, 3))}
    grey = {k: a[..., :1] for k, a in images.items()}
    one = arrays(procedural.dither(relation(spark, grey, 1)))
    palette = [(k * 37 % 256, k * 91 % 256, k * 53 % 256) for k in range(24)]
    few = arrays(procedural.quantize_to(relation(spark, images, 3), palette))
    near = lambda v: (i := min(range(24), key=lambda i: (sum((v - palette[i]) ** 2), i)), np.array(palette[i]))
    spread = arrays(procedural.effect_spread(relation(spark, images, 3), 3))
    for k, a in images.items():
        assert np.array_equal(one[k][..., 0], brute_diffused(a[..., :1], lambda v: (255, 255) if v[0] > 128 else (0, 0)))
        assert np.array_equal(few[k][..., 0], brute_diffused(a, near))
        x, out = 1, a.copy()
        for i in range(a.shape[0] * a.shape[1]):
            place = [i % a.shape[1], i // a.shape[1]]
            there = []
            for axis in (0, 1):
                x = x * 16807 % (2**31 - 1)
                there.append(place[axis] + x % 4 - 1)
            if 0 <= there[0] < a.shape[1] and 0 <= there[1] < a.shape[0]:
                out[place[1], place[0]], out[there[1], there[0]] = a[there[1], there[0]], a[place[1], place[0]]
        assert np.array_equal(spread[k], out)
    made = procedural.noise(1000, 20.0, 5)
    state, values = 5, []
    while len(values) < 1000:
        pair = []
        for _ in range(2):
            state = state * 16807 % (2**31 - 1)
            pair.append(2 * state / (2**31 - 1) - 1)
        r = pair[0] ** 2 + pair[1] ** 2
        if 0 < r < 1:
            values += [int(min(255, max(0, 128 + 20 * v * math.sqrt(-2 * math.log(r) / r)))) for v in pair]
    assert made == values[:1000]


@pytest.mark.parametrize("method", [0, 1])
def test_quantize(spark, images, method):
    df = relation(spark, images, 3)
    found, palette = procedural.quantize(df, 5, method, 2)
    assert found.agg(F.max("b0")).first()[0] < 5
    back = arrays(color.expand_palette(found, palette.withColumn("a", F.lit(255))))
    table = {}
    for r in palette.collect():
        table.setdefault(r["image_id"], []).append([r["r"], r["g"], r["b"]])
    for k, a in images.items():
        gap = ((a[..., None, :3] - np.array(table[k])) ** 2).sum(-1).min(-1)
        assert np.array_equal(((back[k] - a[..., :3]) ** 2).sum(-1), gap)
    with pytest.raises(ValueError):
        procedural.quantize(df, 5, 3)


def test_shapes(spark):
    df = relation(spark, {1: np.zeros((20, 20, 1), int)}, 1)
    shape = lambda out: arrays(out)[1][..., 0]
    circle = shape(draw.circle(df, (9.5, 9.5), 8.5, fill=[255]))
    assert np.array_equal(circle, circle.T) and np.array_equal(circle, circle[::-1]) and abs((circle > 0).sum() - math.pi * 81) < 12
    ring = shape(draw.ellipse(df, (1, 1, 18, 18), outline=[255], width=2))
    assert ring[9, 9] == 0 and ring[9, 1] == ring[9, 2] == 255 and ring[9, 3] == 0
    triangle = shape(draw.polygon(df, [(2, 2), (17, 2), (2, 17)], fill=[9]))
    assert (triangle > 0).sum() == 16 * 17 // 2
    pie, arc, chord = (shape(f(df, (1, 1, 18, 18), 0, 90, fill=[255])) for f in (draw.pieslice, draw.arc, draw.chord))
    assert pie[12, 12] == 255 and pie[5, 5] == pie[12, 5] == 0
    assert ((arc > 0) <= (pie > 0)).all() and ((chord > 0) <= (circle > -1)).all() and chord[10, 10] == 0 and chord[15, 15] == 255
    box = shape(draw.rounded_rectangle(df, (2, 2, 17, 17), 5, fill=[255], corners=(True, False, False, False)))
    assert box[2, 2] == 0 and box[2, 17] == box[17, 2] == box[17, 17] == 255
    assert (shape(draw.line(df, [(0, 5), (19, 5)], [255], 3)) > 0).sum() == 60
    assert len(shapes.line_points((0, 0), (7, 3))) == 8


def test_masked_operators(spark, images):
    df = relation(spark, images, 1)
    mask = df.withColumn("b0", F.when(F.col("x") < 2, 255).otherwise(0))
    stats = {r["image_id"]: r for r in reductions.statistics(df, mask).collect()}
    for k, a in images.items():
        own = np.sort(a[:, :2, 0].ravel())
        assert stats[k]["count"] == own.size and stats[k]["sum"] == own.sum() and stats[k]["median"] == own[own.size // 2]
    assert abs(reductions.entropy(df, mask).where("image_id = 3").first()["entropy"]) < 1e-9
    equal(arrays(equalization.autocontrast(df, mask=df.withColumn("b0", F.lit(0)))), {k: a[..., :1] for k, a in images.items()})
    assert reductions.bounding_box(df).where("image_id = 3").count() == 0


def test_modes_are_checked(spark, images):
    one, three = relation(spark, images, 1), relation(spark, images, 3)
    with pytest.raises(ValueError):
        binary.add(one, three)
    with pytest.raises(ValueError):
        point.point(three, [0] * 10)
    with pytest.raises(ValueError):
        color.convert(one, "L", "XYZ")


def test_color_cube(spark, images):
    df = relation(spark, images, 3)
    table = point.lut_table((3, 4, 5), lambda r, g, b: (1 - r, g, b))
    found = arrays(point.color_lut_3d(df, (3, 4, 5), table))
    for k, a in images.items():
        assert abs(found[k] - np.stack([255 - a[..., 0], a[..., 1], a[..., 2]], axis=-1)).max() <= 1


def test_empty_relations(spark, images):
    none = relation(spark, images, 3).where("false")
    for fn in (point.invert, lambda d: point.contrast(d, 2), geometry.flip, lambda d: geometry.crop(d, (-1, 0, 3, 3)),
               lambda d: resample.resize(d, (3, 3)), lambda d: neighborhood.named_filter(d, "BLUR"), equalization.equalize, reductions.histogram, reductions.statistics):
        assert fn(none).count() == 0
    assert list(none.columns)[:5] == list(KEYS)


def test_streams_of_frames(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(1, at(1), 2, 1, [10, 20]), (2, at(5), 1, 1, [30]), (3, at(15), 1, 2, [7, 9])]
    spark.createDataFrame(rows, frames.FRAMES).write.parquet(str(tmp_path / "in"))
    stream = frames.windowed_levels(frames.read_frames(spark, str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("levels").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["n_pixels"], r["mean"], r["lo"], r["hi"]) for r in spark.sql("SELECT * FROM levels").collect()) == [(2, 8.0, 7, 9), (3, 20.0, 10, 30)]
    inverted = point.invert(frames.pixels(frames.read_frames(spark, str(tmp_path / "in")))).writeStream.format("memory").queryName("inv").start()
    inverted.processAllAvailable()
    inverted.stop()
    assert sorted(r["b0"] for r in spark.sql("SELECT b0 FROM inv").collect()) == [225, 235, 245, 246, 248]


def test_colour_strings_as_hsv(spark):
    import colorsys

    texts = ["rgb(12,200,37)", "#102030", "#fff", "#000", "rgb(255,0,0)", "rgb(10,10,200)", "rgb(200,10,190)"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", getcolor(F.col("t"), "RGB").alias("c"), getcolor(F.col("t"), "HSV").alias("hsv"))
    for r in df.collect():
        assert r["hsv"] == [int(v * 255) for v in colorsys.rgb_to_hsv(*(c / 255 for c in r["c"]))], r["t"]


def test_array_interfaces(spark):
    assert pixels.array_layout((5, 7), "|u1") == ("L", 7, 5) and pixels.array_layout((5,), ">f8") == ("F", 1, 5)
    assert pixels.array_layout((5, 7, 4), "|u1", "CMYK") == ("CMYK", 7, 5)
    for shape, kind, mode, error in (((2, 2, 5), "|u1", None, TypeError), ((2, 2), "<c8", None, TypeError), ((2, 2, 3), "|u1", "L", ValueError), ((), "|u1", None, IndexError)):
        with pytest.raises(error):
            pixels.array_layout(shape, kind, mode)
    a = np.array([[1, -2, 300], [70_000, 5, 0]], ">i4")
    out = arrays(pixels.from_typed_array(spark.createDataFrame([(1, a.tobytes())], "image_id bigint, d binary"), "d", a.shape, ">i4"))
    assert np.array_equal(out[1][..., 0], a)
    b = np.array([[True, False]])
    out = arrays(pixels.from_typed_array(spark.createDataFrame([(1, b.tobytes())], "image_id bigint, d binary"), "d", b.shape, "|b1"))
    assert out[1][..., 0].tolist() == [[255, 0]]


def test_lut_transformed():
    size = (2, 3, 2)
    table = point.lut_table(size, lambda r, g, b: (r, g, b))
    assert point.lut_transformed(size, table, lambda r, g, b: (b, g, r)) == point.lut_table(size, lambda r, g, b: (b, g, r))
    mixed = point.lut_transformed(size, [0.5] * len(table), lambda nr, ng, nb, r, g, b: (nr * r, ng * g, nb * b), True)
    assert mixed == [v * 0.5 for v in table]


def test_only_three_filters_sample_at_a_place(spark):
    from rasterloom.operators import resample as S

    df = spark.createDataFrame([(1, 2, 2, x, y, x + y) for x in (0, 1) for y in (0, 1)], "image_id int, w int, h int, x int, y int, b0 int")
    for call in (lambda f: S.rotate(df, 30, f), lambda f: S.transform_affine(df, (2, 2), (1, 0, 0, 0, 1, 0), f), lambda f: S.transform_quad(df, (2, 2), (0, 0, 0, 2, 2, 2, 2, 0), f)):
        for name in ("LANCZOS", "BOX", "HAMMING", "bicubic", "NO_SUCH"):
            with pytest.raises(ValueError):
                call(name)


def test_bicubic_samples_of_images_of_many_sizes(spark):
    """Flat images stay flat to the edge, one pixel wide or more; pixel middles give the pixels."""
    from rasterloom.operators import resample as S

    rng = random.Random(8)
    images = {k: (w, h, [[rng.randrange(256) for _ in range(w)] for _ in range(h)]) for k, (w, h) in enumerate([(1, 1), (2, 3), (7, 5)])}
    rows = [(k, w, h, x, y, v[y][x], 99) for k, (w, h, v) in images.items() for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "image_id int, w int, h int, x int, y int, b0 int, b1 int")
    same = {(r["image_id"], r["x"], r["y"]): (r["b0"], r["b1"]) for r in S.rotate(df, 0.0, "BICUBIC", center=(0, 0)).collect()}
    assert same == {(k, x, y): (a, b) for k, _, _, x, y, a, b in rows}
    turned = S.rotate(df, 17, "BICUBIC", fill=[0, 99]).collect()
    assert len(turned) == len(rows) and {r["b1"] for r in turned} == {99}


def _operators(df):
    """df's plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_not_broadcast_and_images_fill_tasks(spark, tmp_path):
    from rasterloom import queries
    from rasterloom.sources import tables

    at = "/root/testdata/sf0.001"
    for name in ("op_autocontrast", "op_equalize", "op_expand_palette", "op_rotate", "op_rotate_bicubic", "op_transform_affine_bicubic", "op_rotate_bicubic_rgba",
                 "op_transform_perspective_bicubic", "op_putdata", "op_putalpha", "op_merge", "op_blend", "op_font_mask"):
        plan = _operators(queries.QUERIES[name](spark, at))
        assert "SortMergeJoin" in plan, name
        assert name == "op_font_mask" or "BroadcastHashJoin" not in plan, name
    spark.range(3000).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    pixels = tables.suppliers(spark, str(tmp_path))
    assert pixels.rdd.getNumPartitions() == 6  # 3,000 images of 1,024 pixels, and 2**19 pixels a task
    assert _operators(pixels.groupBy("image_id", "y").count()).count("Exchange") == 1  # that of the images


def test_samples_of_tiles_are_those_of_all_taps(spark):
    """Images of several tiles, by the taps one by one; of pixels that come twice the higher sample counts."""
    affine = lambda df, c, how: resample.transform_affine(df, (50, 60), c, how, [9])
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (70, 41))
    df = relation(spark, {7: a[..., None], 8: a[:3, :2, None]}, 1)
    c = (0.9, 0.2, -3.0, -0.3, 1.1, 5.0)
    for n, how in ((2, "BILINEAR"), (4, "BICUBIC")):
        found = arrays(affine(df, c, how))
        for k, img in ((7, a), (8, a[:3, :2])):
            h, w = img.shape
            for y in range(0, 60):
                for x in range(0, 50, 3):
                    sx, sy = c[0] * (x + 0.5) + c[1] * (y + 0.5) + c[2], c[3] * (x + 0.5) + c[4] * (y + 0.5) + c[5]
                    wanted = 9
                    if 0 <= sx < w and 0 <= sy < h:
                        u, v = math.floor(sx - 0.5), math.floor(sy - 0.5)
                        near = lambda p, m: max(0, min(p, m - 1))
                        first = -1 if n == 4 else 0
                        tap = [[float(img[near(v + first + j, h), near(u + first + i, w)]) for i in range(n)] for j in range(n)]
                        rows = [resample._mixed(t, sx - 0.5 - u) for t in tap]
                        wanted = int(max(0, min(255, resample._mixed(rows, sy - 0.5 - v))))
                    assert found[k][y, x, 0] == wanted, (k, x, y)
    once = arrays(affine(df, c, "BICUBIC"))
    twice = df.unionByName(df.withColumn("b0", F.lit(0)))
    equal(arrays(affine(twice, c, "BICUBIC")), once)
    shape = affine(df.where("image_id = 7"), c, "BICUBIC")
    assert shape.count() == 60 * 50 and shape.where("b0 is null").count() == 0


def test_palette_text_fills_gaps_and_refuses_doubles(spark):
    rows = spark.createDataFrame([(1, 3, 10, 20, 30, 255), (1, 255, 1, 2, 3, 255), (2, 0, 7, 8, 9, 255), (1, 300, 0, 0, 0, 255)], "image_id bigint, idx int, r int, g int, b int, a int")
    found = {r["image_id"]: r["text"] for r in color.palette_text(rows).collect()}
    lines = lambda known: "# Palette\n# Mode: RGB\n" + "\n".join(f"{k} {known.get(k, '0 0 0')}" for k in range(256)) + "\n"
    assert found == {1: lines({3: "10 20 30", 255: "1 2 3"}), 2: lines({0: "7 8 9"})}
    with pytest.raises(Exception, match="two entries"):
        color.palette_text(rows.unionByName(rows)).collect()


def test_keys_are_handed_over_whole_and_in_one_call_of_python_a_batch(spark):
    """Keys that reach over Arrow batches of three rows, and the plan, which has no call for each group."""
    rows = spark.createDataFrame([(k, j) for k in range(40) for j in range(k % 9 + 1)], "image_id bigint, v int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = procedural._by_key(rows, ["image_id"], lambda r: np.array([[r[0, 0], len(r), r[:, 1].sum()]]), ["image_id bigint", "n int", "s bigint"])
        assert sorted(map(tuple, out.collect())) == [(k, k % 9 + 1, sum(range(k % 9 + 1))) for k in range(40)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    colours = spark.range(64).selectExpr("0L AS image_id", "8 AS w", "8 AS h", "cast(id % 8 AS int) AS x", "cast(id / 8 AS int) AS y", *(f"cast(id * {k + 3} % 256 AS int) AS b{k}" for k in range(3)))
    for method in range(3):
        plan = _operators(procedural.quantize(colours, 4, method)[0])
        assert "MapInArrow" in plan and "Groups" not in plan

"""Operators with a serial dependency inside an image. Images are independent: each is an array of samples
in one row, and a vectorised function maps batches of such rows. An image must fit in memory, not more."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..relation import KEYS, bands, with_bands, with_rows
from ..sources.pixels import to_frames
from .color import convert, put_palette, to_web_palette, web_palette


def per_image(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], n_out: int | None = None) -> DataFrame:
    """fn from an image (h, w, bands) to one of the same size with n_out bands, both int64."""
    own = bands(df)
    n_in, n_out = len(own), n_out or len(own)

    @F.pandas_udf("array<int>")
    def mapped(w: pd.Series, h: pd.Series, samples: pd.Series) -> pd.Series:
        out = [fn(np.asarray(s, np.int64).reshape(hh, ww, n_in)) for ww, hh, s in zip(w, h, samples, strict=True)]
        return pd.Series([np.asarray(o, np.int32).ravel() for o in out], dtype=object)

    frames = to_frames(df).withColumn("samples", mapped("w", "h", "samples"))
    rows = frames.select("image_id", "w", "h", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1), lambda i: F.slice("samples", i * n_out + 1, n_out))).alias("i", "s"))
    return rows.select("image_id", "w", "h", (F.col("i") % F.col("w")).alias("x"), F.floor(F.col("i") / F.col("w")).cast("int").alias("y"),
                       *(F.col("s")[k].alias(f"b{k}") for k in range(n_out)))


def floyd_steinberg(img: np.ndarray) -> np.ndarray:
    """L (luma cut, not rounded) to 0 and 255, the error carried in sixteenths: 7 right, 3, 5 and 1 below."""
    h, w, _ = img.shape
    out = np.zeros((h, w, 1), np.int64)
    below = np.zeros(w + 2, np.int64)
    for y in range(h):
        carried, below = below, np.zeros(w + 2, np.int64)
        right = 0
        for x in range(w):
            v = img[y, x, 0] + int((right + carried[x + 1]) / 16)
            v = min(255, max(0, v))
            out[y, x, 0] = 255 if v > 128 else 0
            error = v - out[y, x, 0]
            right = 7 * error
            below[x] += 3 * error
            below[x + 1] += 5 * error
            below[x + 2] += error
    return out


def dither(df: DataFrame) -> DataFrame:
    """L to 1 by error diffusion."""
    return per_image(df, floyd_steinberg, 1)


#: The generator x -> 16807 x mod 2**31 - 1. The k-th number after x is x * 16807**k, so any can be had by itself.
FACTOR, MODULUS = 16807, 2147483647
#: Places are taken apart into digits of so many bits, whose powers are looked up.
_DIGIT, _DIGITS = 10, 4


def draws(first: int, count: int, seed: int = 1) -> np.ndarray:
    """The numbers first, first + 1, ... of the generator's stream after the seed, 0 being the first."""
    out = np.empty(count, np.int64)
    if count:
        out[0] = seed * pow(FACTOR, first + 1, MODULUS) % MODULUS
    done = 1
    while done < count:  # as many again, by one power
        more = min(done, count - done)
        out[done : done + more] = out[:more] * pow(FACTOR, done, MODULUS) % MODULUS
        done += more
    return out


def drawn(place: Column) -> Column:
    """The number at a place (a bigint under 2**40) of the stream after the seed 1, by digits of the place."""
    number = F.lit(FACTOR).cast("bigint")
    for k in range(_DIGITS):
        # One literal, which the optimizer takes apart once.
        powers = F.split(F.lit(",".join(str(pow(FACTOR, j << (_DIGIT * k), MODULUS)) for j in range(1 << _DIGIT))), ",").cast("array<bigint>")
        digit = F.shiftright(place, _DIGIT * k).bitwiseAND(F.lit((1 << _DIGIT) - 1)).cast("int")
        number = number * F.get(powers, digit) % MODULUS
    return number


def noise(size: int, sigma: float, seed: int = 1) -> list[int]:
    """128 with normal noise, by the polar method, cut to 0..255. Pairs of the stream are tried in order, and give two
    numbers each if they are in the circle."""
    out: list[np.ndarray] = []
    made = tried = 0
    while made < size:
        n = (size - made) * 2 // 3 + 16
        u, v = (2.0 * draws(2 * tried, 2 * n, seed).reshape(n, 2) / float(MODULUS) - 1.0).T
        r = u * u + v * v
        kept = (r > 0) & (r < 1)
        f = np.sqrt(-2.0 * np.log(r[kept]) / r[kept])
        out.append(np.column_stack([f * u[kept], f * v[kept]]).ravel())
        made, tried = made + len(out[-1]), tried + n
    values = np.concatenate(out or [np.empty(0)])[:size]
    return np.clip(128 + sigma * values, 0, 255).astype(np.int64).tolist()


def effect_noise(frames: DataFrame, sigma: float) -> DataFrame:
    """An L image for each of (image_id, w, h); an image's stream starts from its id."""
    @F.pandas_udf("array<int>")
    def made(i: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([noise(a * b, sigma, 1 + int(k) % 2147483646) for k, a, b in zip(i, w, h, strict=True)], dtype=object)

    rows = frames.select("image_id", "w", "h", F.posexplode(made("image_id", "w", "h")).alias("i", "b0"))
    return rows.select("image_id", "w", "h", (F.col("i") % F.col("w")).alias("x"), F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), "b0")


def effect_spread(df: DataFrame, distance: int) -> DataFrame:
    """Each pixel changes places with one at a random place near it, if that is inside the image: in row order, with the
    samples of the image as it was, so what comes last to a place stays. A pixel's two numbers are those at twice its
    place in the image's stream, so pixels are drawn in parallel."""
    own = bands(df)
    at = F.col("y").cast("bigint") * F.col("w") + F.col("x")
    step = lambda k: (drawn(2 * at + k) % (distance + 1)).cast("int") - distance // 2
    rows = df.withColumns({"__at": at, "__x": F.col("x") + step(0), "__y": F.col("y") + step(1)})
    inside = (F.col("__x") >= 0) & (F.col("__x") < F.col("w")) & (F.col("__y") >= 0) & (F.col("__y") < F.col("h"))
    source = df.select("image_id", F.col("x").alias("__x"), F.col("y").alias("__y"), *(F.col(b).alias(f"__{b}") for b in own))
    pairs = with_rows(rows.where(inside), source, ["image_id", "__x", "__y"])
    write = lambda x, y, when, *samples: F.struct(x.alias("x"), y.alias("y"), when.alias("t"), *(v.alias(b) for b, v in zip(own, samples, strict=True)))
    here = write(F.col("x"), F.col("y"), F.col("__at"), *(F.col(f"__{b}") for b in own))
    there = write(F.col("__x"), F.col("__y"), F.col("__at"), *map(F.col, own))
    changed = pairs.select("image_id", "w", "h", F.inline(F.array(here, there)))
    kept = df.select("image_id", "w", "h", "x", "y", F.lit(-1).cast("bigint").alias("t"), *own)
    last = kept.unionByName(changed).groupBy(*KEYS).agg(F.max_by(F.struct(*own), "t").alias("__s"))
    return last.select(*KEYS, *(F.col(f"__s.{b}").alias(b) for b in own))


def _nearest(points: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """The first of the nearest entries, for some ten thousand points at a time."""
    parts = [points[k : k + 16_384] for k in range(0, len(points), 16_384)]
    return np.concatenate([((p[:, None, :] - palette[None]) ** 2).sum(axis=2).argmin(axis=1) for p in parts] or [np.empty(0, np.int64)])


def _means(points: np.ndarray, counts: np.ndarray, group: np.ndarray, old: np.ndarray) -> np.ndarray:
    n = np.bincount(group, counts, len(old))
    sums = np.stack([np.bincount(group, counts * points[:, k], len(old)) for k in range(points.shape[1])], axis=1)
    return np.where(n[:, None] > 0, np.floor(sums / np.maximum(n, 1)[:, None] + 0.5), old).astype(np.int64)


#: A histogram has so many cells at most; a band loses bits until it has. Without three of them it always has.
CELLS, COARSEST = 65_536, 3
#: Weights of the bands where the longest side of a box is looked for.
_SIDES = np.array([77, 150, 29])


class _Fullest:
    """A binary heap of boxes by their pixels. Of equal ones that came up first stays above: a box rises only over smaller
    ones, the left one of two equal children is taken, and sinks under equal ones."""

    def __init__(self) -> None:
        self.heap: list[tuple[int, tuple[int, int]]] = []

    def push(self, pixels: int, box: tuple[int, int]) -> None:
        at = len(self.heap)
        self.heap.append((pixels, box))
        while at and self.heap[(at - 1) // 2][0] < pixels:
            self.heap[at] = self.heap[(at - 1) // 2]
            at = (at - 1) // 2
        self.heap[at] = (pixels, box)

    def pop(self) -> tuple[int, int]:
        top, moved = self.heap[0], self.heap.pop()
        if self.heap:
            at, n = 0, len(self.heap)
            while (child := 2 * at + 1) < n:
                child += child + 1 < n and self.heap[child + 1][0] > self.heap[child][0]
                if self.heap[child][0] < moved[0]:
                    break
                self.heap[at] = self.heap[child]
                at = child
            self.heap[at] = moved
        return top[1]


def _cut(cells: np.ndarray, counts: np.ndarray, order: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts boxes, the stretches from a to b of order: (where each one's low half starts, pixels of its high half and of all).
    The high half comes first: the fewest highest levels of the longest side with over half of the pixels, but not all levels.
    A box of one level is left alone, its low half starts at a."""
    length = b - a
    first, last = np.cumsum(length) - length, np.cumsum(length) - 1
    box = np.repeat(np.arange(len(a)), length)
    at = np.arange(len(box)) + (a - first)[box]
    own = cells[order[at]]
    side = ((np.maximum.reduceat(own, first) - np.minimum.reduceat(own, first)) * _SIDES).argmax(axis=1)
    level = own[np.arange(len(own)), side[box]]
    falling = np.argsort((box << 8) - level, kind="stable")
    order[at], level = order[at][falling], level[falling]
    above = np.cumsum(counts[order[at]])
    above -= np.concatenate([[0], above[last[:-1]]])[box]
    pixels = above[last]
    half = np.minimum.reduceat(np.where(2 * above > pixels[box], np.arange(len(box)), len(box)), first)
    high = np.add.reduceat((level >= np.maximum(level[half], level[last] + 1)[box]).astype(np.int64), first)
    return a + high, np.where(high > 0, above[first + high - 1], 0), pixels


def median_cut(first: np.ndarray, cells: np.ndarray, counts: np.ndarray, sums: np.ndarray, colors: int) -> tuple[np.ndarray, np.ndarray]:
    """(box of each cell, palette of each image) of images whose cells follow each other, from first on. An image's box with the
    most pixels is cut, again and again, in all images together. Boxes are numbered by the cuts they come from, high halves
    first; entries without a box are the last one's."""
    ends = np.append(first[1:], len(cells))
    order, starts = np.arange(len(cells)), np.zeros(len(cells), bool)
    starts[first] = True
    few = ends - first <= colors
    a, b = first[few], ends[few]
    while len(a):  # all boxes are cut, whatever comes first
        low = _cut(cells, counts, order, a, b)[0]
        starts[low] = True
        cut = low > a
        a, b = np.concatenate([a[cut], low[cut]]), np.concatenate([low[cut], b[cut]])
        a, b = a[b - a > 1], b[b - a > 1]
    heaps = {k: _Fullest() for k in np.flatnonzero(~few).tolist()}
    left = dict.fromkeys(heaps, colors - 1)
    for k, heap in heaps.items():
        heap.push(int(counts[first[k] : ends[k]].sum()), (int(first[k]), int(ends[k])))
    while live := [k for k, heap in heaps.items() if left[k] and heap.heap]:
        boxes = [heaps[k].pop() for k in live]
        cuts = _cut(cells, counts, order, *np.array(boxes).T)
        starts[cuts[0]] = True
        for k, (a, b), low, high, pixels in zip(live, boxes, *(c.tolist() for c in cuts), strict=True):
            if low > a:
                left[k] -= 1
                heaps[k].push(high, (a, low))
                heaps[k].push(pixels - high, (low, b))
    box, edges = np.cumsum(starts) - 1, np.flatnonzero(starts)
    n = np.add.reduceat(counts[order], edges)[:, None]
    means = (np.add.reduceat(sums[order], edges) + n // 2) // n
    index = np.empty(len(cells), np.int64)
    index[order] = box - np.repeat(box[first], ends - first)
    return index, means[np.minimum(box[first][:, None] + np.arange(colors), box[ends - 1][:, None])]


def _nearer(points: np.ndarray, start: np.ndarray, palettes: np.ndarray, image: np.ndarray) -> np.ndarray:
    """The nearest entry of its image's palette to each point; of equally near ones the point's own one (start), then what is
    nearest to that. A point that is its own entry stays."""
    out, colors = start.copy(), palettes.shape[1]
    off = np.flatnonzero((points != palettes[image, start]).any(axis=1))
    step = max(1, (1 << 20) // colors)
    for rows in (off[k : k + step] for k in range(0, len(off), step)):
        own, table = start[rows], palettes[image[rows]]
        away = ((points[rows, None] - table) ** 2).sum(axis=2)
        gaps = ((palettes[image[rows], own][:, None] - table) ** 2).sum(axis=2) + 1
        gaps[np.arange(len(rows)), own] = 0
        out[rows] = ((away << 26) | (gaps << 8) | np.arange(colors)).min(axis=1) & 255
    return out


def max_coverage(points: np.ndarray, counts: np.ndarray, colors: int) -> np.ndarray:
    """A palette of colours each as far as can be from those before; the first is the most frequent."""
    chosen = [int(counts.argmax())]
    far = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < colors and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


#: Bits of a band in the fine and in the coarse cube, without and with alpha.
_CUBES = {3: ((4, 4, 4), (2, 2, 2)), 4: ((3, 4, 3, 3), (2, 2, 2, 2))}


def _cube_index(points: np.ndarray, bits: Sequence[int]) -> np.ndarray:
    """Which cube of a grid with so many bits a band each point is in."""
    out = np.zeros(len(points), np.int64)
    for k, n in enumerate(bits):
        out = (out << n) | (points[:, k] >> (8 - n))
    return out


def octree(points: np.ndarray, counts: np.ndarray, sums: np.ndarray, colors: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of each fine cube, palette) from an image's fine cubes: a point in each, pixels, sums of samples.

    Every coarse cube in use has an entry as far as there are entries, the fullest fine cubes have the others.
    A fine cube with an entry no longer counts in its coarse one; one that is emptied so frees its entry."""
    fine, coarse = _CUBES[points.shape[1]]
    at_fine, at_coarse = _cube_index(points, fine), _cube_index(points, coarse)
    left = np.bincount(at_coarse, counts, 1 << sum(coarse)).astype(np.int64)
    left_sums = np.stack([np.bincount(at_coarse, s, len(left)) for s in sums.T], axis=1).astype(np.int64)
    fullest = np.lexsort((at_fine, -counts))
    n_coarse = min(colors, int((left > 0).sum()))
    taken = 0
    while True:
        for k in fullest[taken : colors - n_coarse]:
            left[at_coarse[k]] -= counts[k]
            left_sums[at_coarse[k]] -= sums[k]
        taken = colors - n_coarse
        if n_coarse <= (used := int((left > 0).sum())):
            break
        n_coarse = used
    cubes = np.argsort(-left, kind="stable")[:n_coarse]
    own = fullest[: colors - n_coarse]
    palette = np.zeros((colors, points.shape[1]), np.int64)
    palette[:n_coarse] = left_sums[cubes] // np.maximum(left[cubes, None], 1)
    palette[n_coarse : n_coarse + len(own)] = sums[own] // counts[own, None]
    of_coarse = np.zeros(len(left), np.int64)
    of_coarse[cubes[::-1]] = np.arange(n_coarse)[::-1]
    index = of_coarse[at_coarse]
    index[own] = n_coarse + np.arange(len(own))
    return index, palette


#: Distinct colours that look for their entry together.
_TOGETHER = 65_536


def _by_keys(df: DataFrame, keys: Sequence[str], made: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: Sequence[str]) -> DataFrame:
    """made from the rows of whole keys, numbers in df's columns, and the first row of each, to rows of shape (name and type).
    df is in tasks by its key; a task sorts its rows and hands over many keys at once, as a call of Python for each would take
    longer than its work."""
    schema = pa.schema([(n, pa.int64() if t == "bigint" else pa.int32()) for n, t in (s.split() for s in shape)])
    at, together = [df.columns.index(k) for k in keys], _TOGETHER

    def firsts(rows: np.ndarray) -> np.ndarray:
        own = rows[:, at]
        return np.concatenate([[0], np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1])

    def done(rows: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        out = made(rows, first)
        return pa.RecordBatch.from_arrays([pa.array(out[:, k], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, together
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            n += batch.num_rows
            if n < enough:
                continue
            rows = np.concatenate(held)
            *first, last = firsts(rows)
            if first:
                yield done(rows[:last], np.array(first))
            held, n = [rows[last:]], len(rows) - last  # the last key can go on
            enough = max(together, 2 * n)
        if held:
            rows = np.concatenate(held)
            yield done(rows, firsts(rows))

    # Without a number Spark merges tasks with few rows.
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join(shape))


def _by_key(df: DataFrame, keys: Sequence[str], made: Callable[[np.ndarray], np.ndarray], shape: Sequence[str]) -> DataFrame:
    """made from the rows of each key."""
    return _by_keys(df, keys, lambda rows, first: np.concatenate([made(g) for g in np.split(rows, first[1:])]), shape)


def _by_octree(df: DataFrame, colors: int) -> tuple[DataFrame, DataFrame]:
    """Pixels are counted by fine cube by Spark, so an image is at most 8,192 rows where its palette is made."""
    own = bands(df)
    if len(own) == 4:  # pixels that cannot be seen have one colour, that of the first of them
        clear = df.where("b3 = 0").groupBy("image_id").agg(F.min_by(F.struct("b0", "b1", "b2"), F.struct("y", "x")).alias("__c"))
        df = df.join(clear, "image_id", "left").withColumns({b: F.when(F.col("b3") == 0, F.col(f"__c.{b}")).otherwise(F.col(b)) for b in own[:3]}).drop("__c")
    cube = F.lit(0)
    for b, n in zip(own, _CUBES[len(own)][0], strict=True):
        cube = F.shiftleft(cube, n).bitwiseOR(F.shiftright(F.col(b).cast("int"), 8 - n))
    df = df.withColumn("__cube", cube)
    cubes = df.groupBy("image_id", "__cube").agg(
        F.count(F.lit(1)).alias("n"), *(F.min(b).cast("int").alias(b) for b in own), *(F.sum(b).alias(f"s{b}") for b in own))

    n_bands = len(own)

    def made(rows: np.ndarray) -> np.ndarray:
        rows = rows[rows[:, 1].argsort()]
        index, palette = octree(rows[:, 3 : 3 + n_bands], rows[:, 2], rows[:, 3 + n_bands :], colors)
        entry = np.arange(colors)
        of = np.concatenate([index, entry])
        return np.column_stack([np.full(len(of), rows[0, 0]), np.concatenate([rows[:, 1], -1 - entry]), of, palette[of]])

    mapped = _by_key(cubes, ["image_id"], made, ["image_id bigint", "cube int", "idx int", *(f"p{k} int" for k in range(n_bands))])
    found = mapped.where("cube >= 0").select("image_id", F.col("cube").alias("__cube"), "idx")
    pixels = with_rows(df, found, ["image_id", "__cube"]).select(*KEYS, F.col("idx").alias("b0"))
    names = zip(range(len(own)), ("r", "g", "b", "a"), strict=False)
    return pixels, mapped.where("cube < 0").select("image_id", "idx", *(F.col(f"p{k}").alias(n) for k, n in names))


def _assigned(started: DataFrame, palette: DataFrame) -> DataFrame:
    """started (image_id, buckets, b0, b1, b2, n, start) with idx, the entry of each colour; start becomes idx. Colours of an
    image are dealt into buckets, each of which gets the palette (image_id, buckets, idx, p0, p1, p2)."""
    own = ["b0", "b1", "b2"]
    dealt = started.withColumn("bucket", F.pmod(F.xxhash64(*own), F.col("buckets")).cast("int")).select("image_id", "bucket", "buckets", *own, "n", "start")
    copies = palette.withColumn("bucket", F.explode(F.expr("sequence(0, buckets - 1)")))
    # Entries are rows without pixels.
    entries = copies.select("image_id", "bucket", "buckets", *(F.col(f"p{k}").alias(b) for k, b in enumerate(own)), F.lit(0).cast("bigint").alias("n"), F.col("idx").alias("start"))

    def made(rows: np.ndarray) -> np.ndarray:
        table, colours = rows[rows[:, 6] == 0], rows[rows[:, 6] > 0]
        index = _nearer(colours[:, 3:6], colours[:, 7], table[None, table[:, 7].argsort(), 3:6], np.zeros(len(colours), np.int64))
        return np.column_stack([colours[:, [0, 2, 3, 4, 5, 6]], index])

    shape = ["image_id bigint", "buckets int", "b0 int", "b1 int", "b2 int", "n bigint", "start int"]
    return _by_key(dealt.unionByName(entries), ["image_id", "bucket"], made, shape)


def _by_median_cut(df: DataFrame, colors: int, kmeans: int, kept: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Colours are counted by Spark. An image whose places are no more than its cells may be has its boxes, entries and means
    made from its counted colours in one pass, together with others; a larger one is dealt. Pixels keep the columns kept."""
    places, most = F.col("w").cast("bigint") * F.col("h"), min(CELLS, _TOGETHER)
    small, large = _by_colours(df.where(places <= most), colors, kmeans, kept), _by_cells(df.where(places > most), colors, kmeans, kept)
    return small[0].unionByName(large[0]), small[1].unionByName(large[1])


def _by_colours(df: DataFrame, colors: int, kmeans: int, kept: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Median cut of images whose colours are all cells."""
    own = ["b0", "b1", "b2"]
    counted = df.groupBy("image_id", *(F.col(b).cast("int").alias(b) for b in own)).agg(F.count(F.lit(1)).alias("n"))

    def tables(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points, counts = rows[:, 1:4], rows[:, 4]
        image = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
        index, palettes = median_cut(first, points, counts, points * counts[:, None], colors)
        index = _nearer(points, index, palettes, image)
        for _ in range(kmeans):
            palettes = _means(points, counts, image * colors + index, palettes.reshape(-1, 3)).reshape(palettes.shape)
            index = _nearer(points, index, palettes, image)
        return index, palettes

    def coloured(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.column_stack([rows[:, :4], tables(rows, first)[0]])

    def entries(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        palettes = tables(rows, first)[1]
        new = np.ones(palettes.shape[:2], bool)  # equal entries that follow each other are one row
        new[:, 1:] = (palettes[:, 1:] != palettes[:, :-1]).any(axis=2)
        image, idx = np.nonzero(new)
        until = np.append(idx[1:], 0) - 1
        return np.column_stack([rows[first[image], 0], idx, np.where(until < 0, colors - 1, until), palettes[image, idx]])

    found = _by_keys(counted, ["image_id"], coloured, ["image_id bigint", *(f"{b} int" for b in own), "idx int"])
    runs = _by_keys(counted, ["image_id"], entries, ["image_id bigint", "idx int", "until int", "r int", "g int", "b int"])
    pixels = with_rows(df, found, ["image_id", *own]).select(*KEYS, F.col("idx").alias("b0"), *kept)
    return pixels, runs.select("image_id", F.explode(F.sequence("idx", "until")).alias("idx"), "r", "g", "b")


def _by_cells(df: DataFrame, colors: int, kmeans: int, kept: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Cells of a histogram whose precision is chosen by the number of colours are counted by Spark too: an image is at most
    CELLS rows where its boxes are cut. Means of rounds of k-means are grouped by Spark."""
    own = ["b0", "b1", "b2"]
    counted = df.groupBy("image_id", *own).agg(F.count(F.lit(1)).alias("n"))
    cell = lambda s: F.struct(*(F.shiftright(F.col(b).cast("int"), s) for b in own))
    found = counted.groupBy("image_id").agg(F.count(F.lit(1)).alias("n0"), *(F.count_distinct(cell(s)).alias(f"n{s}") for s in range(1, COARSEST)))
    fits = F.coalesce(*(F.when(F.col(f"n{s}") <= CELLS, s) for s in range(COARSEST)), F.lit(COARSEST))
    scales = found.select("image_id", fits.alias("scale"), F.ceil(F.col("n0") / _TOGETHER).cast("int").alias("buckets"))
    placed = with_rows(counted, scales, ["image_id"]).withColumns({f"c{k}": F.expr(f"shiftright(cast({b} as int), scale)") for k, b in enumerate(own)})
    cells = placed.groupBy("image_id", "c0", "c1", "c2").agg(F.sum("n").alias("n"), F.max("buckets").alias("buckets"), *(F.sum(F.col("n") * F.col(b)).alias(f"s{b}") for b in own))

    def made(rows: np.ndarray) -> np.ndarray:
        points = rows[:, 1:4]
        index, (palette,) = median_cut(np.zeros(1, np.int64), points, rows[:, 4], rows[:, 6:], colors)
        none = np.full((colors, 3), -1)
        places, values = np.concatenate([points, none]), np.concatenate([np.zeros_like(points), palette])
        return np.column_stack([np.broadcast_to(rows[0, [0, 5]], (len(places), 2)), np.concatenate([index, np.arange(colors)]), places, values])

    mapped = _by_key(cells, ["image_id"], made, ["image_id bigint", "buckets int", "idx int", *(f"{n}{k} int" for n in "cp" for k in range(3))])
    palette = mapped.where("c0 < 0").select("image_id", "buckets", "idx", "p0", "p1", "p2")
    boxes = mapped.where("c0 >= 0").select("image_id", "c0", "c1", "c2", F.col("idx").alias("start"))
    colours = with_rows(placed, boxes, ["image_id", "c0", "c1", "c2"]).select("image_id", "buckets", *(F.col(b).cast("int").alias(b) for b in own), "n", "start")
    colours = _assigned(colours, palette)
    for _ in range(kmeans):
        mean = lambda b: F.floor(F.sum(F.col("n") * F.col(b)) / F.sum("n") + 0.5).cast("int")
        means = colours.groupBy("image_id", F.col("start").alias("idx")).agg(*(mean(b).alias(f"m{k}") for k, b in enumerate(own)))
        palette = with_rows(palette, means, ["image_id", "idx"], "left").select("image_id", "buckets", "idx", *(F.coalesce(f"m{k}", f"p{k}").alias(f"p{k}") for k in range(3)))
        colours = _assigned(colours, palette)
    pixels = with_rows(df, colours.select("image_id", *own, "start"), ["image_id", *own]).select(*KEYS, F.col("start").alias("b0"), *kept)
    return pixels, palette.select("image_id", "idx", F.col("p0").alias("r"), F.col("p1").alias("g"), F.col("p2").alias("b"))


def quantize(df: DataFrame, colors: int = 256, method: int = 0, kmeans: int = 0) -> tuple[DataFrame, DataFrame]:
    """(P pixels, palette (image_id, idx, bands...)). Method 0 is median cut and 1 maximum coverage, of RGB; 2 is the
    fast octree, of RGB or RGBA, which leaves ``kmeans`` aside. Colours are counted by Spark; the palette of an image
    is made from its counted colours or cubes, and pixels find their index by joining on them."""
    if not 1 <= colors <= 256 or method not in (0, 1, 2):
        raise ValueError("bad number of colors or method")
    own = bands(df)
    if len(own) == 4 and method != 2:
        raise ValueError("only the fast octree takes RGBA")
    if method == 2:
        return _by_octree(df, colors)
    if method == 0:
        return _by_median_cut(df, colors, kmeans)
    counted = df.groupBy("image_id", *own).agg(F.count(F.lit(1)).alias("n"))

    def made(rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort(rows[:, -2:0:-1].T)]  # whatever order the rows came in
        points, counts = rows[:, 1:-1], rows[:, -1]
        palette = max_coverage(points, counts, colors)
        for _ in range(kmeans):
            palette = _means(points, counts, _nearest(points, palette), palette)
        index = _nearest(points, palette)
        return np.column_stack([rows[:, :-1], index, palette[index]])

    mapped = _by_key(counted, ["image_id"], made, ["image_id bigint", *(f"{b} int" for b in own), "idx int", *(f"p{k} int" for k in range(len(own)))])
    pixels = with_rows(df, mapped.select("image_id", *own, "idx"), ["image_id", *own]).select(*KEYS, F.col("idx").alias("b0"))
    palette = mapped.groupBy("image_id", "idx").agg(*(F.any_value(f"p{k}").alias(n) for k, n in zip(range(len(own)), ("r", "g", "b", "a"), strict=False)))
    return pixels, palette


def convert_to_palette(df: DataFrame, source: str, alpha: bool = False) -> tuple[DataFrame, DataFrame]:
    """(P pixels, or PA with ``alpha``, palette (image_id, idx, r, g, b, a)), without dithering. Grey modes keep their samples
    over a grey palette; RGBA with its alpha gets a palette of its own by median cut of the colours; others the web palette
    and, with ``alpha``, full alpha."""
    frames = df.select("image_id").distinct()
    if source in ("L", "1", "LA"):
        level = F.col("b1") if source == "LA" else F.lit(255)
        return with_bands(df, F.col("b0"), *([level] if alpha else [])), put_palette(frames, [(k, k, k) for k in range(256)])
    if source == "RGBA":
        if not alpha:
            raise ValueError("RGBA becomes PA; quantize() makes P of it")
        found, palette = _by_median_cut(df.withColumnRenamed("b3", "alpha"), 256, 0, ["alpha"])
        return with_bands(found, F.col("b0"), F.col("alpha")), palette.withColumn("a", F.lit(255))
    found = to_web_palette(convert(df, source, "RGB"))
    return with_bands(found, F.col("b0"), *([F.lit(255)] if alpha else [])), put_palette(frames, web_palette())


def quantize_to(df: DataFrame, palette: Sequence[tuple[int, int, int]]) -> DataFrame:
    """RGB to the nearest of the palette's colours, the error diffused in sixteenths."""
    table = np.array(palette, np.int64)

    def diffused(img: np.ndarray) -> np.ndarray:
        h, w, _ = img.shape
        out, below = np.zeros((h, w, 1), np.int64), np.zeros((w + 2, 3), np.int64)
        for y in range(h):
            carried, below, right = below, np.zeros((w + 2, 3), np.int64), np.zeros(3, np.int64)
            for x in range(w):
                v = np.clip(img[y, x] + np.trunc((right + carried[x + 1]) / 16).astype(np.int64), 0, 255)
                out[y, x, 0] = _nearest(v[None], table)[0]
                error = v - table[out[y, x, 0]]
                right = 7 * error
                below[x] += 3 * error
                below[x + 1] += 5 * error
                below[x + 2] += error
        return out

    return per_image(df, diffused, 1)

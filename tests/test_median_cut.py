"""Median cut against its rules, followed pixel by pixel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import color, procedural


def brute_median_cut(pixels, colors, cells):
    """(palette, index of each pixel). Boxes are lists of pixels; the heap is an array from 1 on."""
    scale = 0
    while len({tuple(p >> scale) for p in pixels}) > cells:
        scale += 1
    low = pixels >> scale
    boxes, children, heap = [list(range(len(pixels)))], {}, [None, 0]
    size = lambda b: len(boxes[b])

    def push(b):
        heap.append(b)
        k = len(heap) - 1
        while k > 1 and size(b) > size(heap[k // 2]):
            heap[k], heap[k // 2] = heap[k // 2], b
            k //= 2

    def pop():
        top, v = heap[1], heap.pop()
        k, n = 1, len(heap) - 1
        if n == 0:
            return top
        while 2 * k <= n:
            c = 2 * k
            if c < n and size(heap[c]) < size(heap[c + 1]):
                c += 1
            if size(v) > size(heap[c]):
                break
            heap[k] = heap[c]
            k = c
        heap[k] = v
        return top

    while len(children) + 1 < colors and len(heap) > 1:
        b = pop()
        own = low[boxes[b]]
        spans = [(int(own[:, k].max()) - int(own[:, k].min())) * weight for k, weight in enumerate((77, 150, 29))]
        side = spans.index(max(spans))
        levels = sorted(set(own[:, side].tolist()))
        if len(levels) < 2:
            continue
        total, at = 0, len(levels)
        while 2 * total <= len(own):
            at -= 1
            total += int((own[:, side] == levels[at]).sum())
        cut = levels[max(at, 1)]
        children[b] = len(boxes)
        boxes.append([i for i in boxes[b] if low[i, side] >= cut])
        boxes.append([i for i in boxes[b] if low[i, side] < cut])
        push(len(boxes) - 2)
        push(len(boxes) - 1)

    def leaves(b):
        return leaves(children[b]) + leaves(children[b] + 1) if b in children else [b]

    order = leaves(0)
    palette = [tuple(int(2 * pixels[boxes[b]][:, k].sum() + size(b)) // (2 * size(b)) for k in range(3)) for b in order]
    palette += [palette[-1]] * (colors - len(palette))
    index = np.zeros(len(pixels), int)
    gap = lambda p, q: sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True))
    for k, b in enumerate(order):
        others = sorted((j for j in range(colors) if j != k), key=lambda j: gap(palette[k], palette[j]))
        for i in boxes[b]:
            best = k
            for j in others:
                if gap(pixels[i], palette[j]) < gap(pixels[i], palette[best]):
                    best = j
            index[i] = best
    return palette, index


@pytest.mark.parametrize("cells,together", [(65_536, 65_536), (40, 7)])
def test_median_cut_follows_its_rules(spark, monkeypatch, cells, together):
    monkeypatch.setattr(procedural, "CELLS", cells)
    monkeypatch.setattr(procedural, "COARSEST", 3 if cells > 40 else 7)
    monkeypatch.setattr(procedural, "_TOGETHER", together)
    rng = np.random.default_rng(9)
    images = {
        1: rng.integers(0, 256, (12, 11, 3)), 2: rng.integers(0, 4, (9, 9, 3)) * 60, 3: np.full((3, 4, 3), 77), 4: np.repeat(rng.integers(0, 256, (5, 6, 1)), 3, axis=2),
        5: rng.integers(0, 3, (16, 16, 3)) * rng.integers(1, 90, 3), 6: rng.integers(0, 256, (1, 1, 3)),
    }
    rows = [(k, a.shape[1], a.shape[0], x, y, *map(int, a[y, x])) for k, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    df = spark.createDataFrame(rows, "image_id bigint, w int, h int, x int, y int, b0 int, b1 int, b2 int")
    for colors in (1, 2, 7, 16):
        pixels, palette = procedural.quantize(df, colors, 0)
        tables, found = {}, {}
        for r in palette.orderBy("idx").collect():
            tables.setdefault(r["image_id"], []).append((r["r"], r["g"], r["b"]))
        for r in pixels.collect():
            found[r["image_id"], r["x"], r["y"]] = r["b0"]
        for k, a in images.items():
            want, index = brute_median_cut(a.reshape(-1, 3), colors, min(cells, 65_536))
            assert tables[k] == want, (k, colors)
            assert [found[k, i % a.shape[1], i // a.shape[1]] for i in range(len(index))] == index.tolist(), (k, colors)


def test_means_of_a_round(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (10, 10, 3))
    rows = [(1, 10, 10, x, y, *map(int, a[y, x])) for y in range(10) for x in range(10)]
    df = spark.createDataFrame(rows, "image_id bigint, w int, h int, x int, y int, b0 int, b1 int, b2 int")
    first, _ = procedural.quantize(df, 6, 0)
    _, palette = procedural.quantize(df, 6, 0, 1)
    joined = df.join(first.select("x", "y", F.col("b0").alias("k")), ["x", "y"]).groupBy("k").agg(*(F.floor(F.avg(f"b{c}") + 0.5).alias(f"m{c}") for c in range(3)))
    assert {(r["k"], r["m0"], r["m1"], r["m2"]) for r in joined.collect()} == {(r["idx"], r["r"], r["g"], r["b"]) for r in palette.collect()}


def _of(spark, images):
    rows = [(k, a.shape[1], a.shape[0], x, y, *map(int, a[y, x])) for k, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id bigint, w int, h int, x int, y int, b0 int, b1 int, b2 int")


def test_small_and_large_images_have_the_same_entries(spark, monkeypatch):
    """Images made in one pass, and the same ones dealt, with rounds of k-means; in between some of them are dealt."""
    rng = np.random.default_rng(4)
    images = {k: rng.integers(0, 256 if k % 2 else 5, (4 + k, 5, 3)) for k in range(6)}
    df = _of(spark, images)
    found = []
    for together in (1 << 16, 30, 1):
        monkeypatch.setattr(procedural, "_TOGETHER", together)
        pixels, palette = procedural.quantize(df, 8, 0, 2)
        found.append((sorted(map(tuple, pixels.collect())), sorted(map(tuple, palette.collect()))))
        assert len(found[-1][0]) == sum(a.shape[0] * 5 for a in images.values()) and len(found[-1][1]) == 8 * len(images)
    assert found[0] == found[1] == found[2]


def test_small_images_are_cut_together(spark):
    """Two passes over the counted colours, one for pixels and one for entries, and two joins of pixels; of the tables' sizes
    Spark knows that no image is dealt. Ten images take as many cuts as one."""
    df = spark.range(640).selectExpr("cast(id / 64 AS bigint) AS image_id", "8 AS w", "8 AS h", "cast(id % 8 AS int) AS x", "cast(id / 8 % 8 AS int) AS y",
                                     *(f"cast(id * {k + 3} % 256 AS int) AS b{k}" for k in range(4)))
    found, palette = procedural.convert_to_palette(df, "RGBA", True)
    out = color.expand_palette(found, palette, alpha=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 3 and plan.count("Join") == 2 and "Expand" not in plan
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    one = np.random.default_rng(3).integers(0, 256, (64, 3))
    for colors in (16, 256):
        index, palettes = procedural.median_cut(np.arange(10) * 64, np.tile(one, (10, 1)), np.ones(640, np.int64), np.tile(one, (10, 1)), colors)
        alone, (entries,) = procedural.median_cut(np.zeros(1, np.int64), one, np.ones(64, np.int64), one, colors)
        assert (index.reshape(10, 64) == alone).all() and (palettes == entries).all()
    twice = np.array([[5, 5, 5], [5, 5, 5], [9, 9, 9]])  # cells that cannot be told apart stay together
    assert procedural.median_cut(np.zeros(1, np.int64), twice, np.ones(3, np.int64), twice, 4)[0].tolist() == [1, 1, 0]


def test_keys_are_whole_wherever_a_task_hands_over(spark, monkeypatch):
    """Keys of up to nine rows, of which a task hands over some two, seven or all at once."""
    rows = spark.createDataFrame([(k, j) for k in range(60) for j in range(k % 9 + 1)], "image_id bigint, v int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    made = lambda r, first: np.column_stack([r[first, 0], np.diff(np.append(first, len(r))), np.add.reduceat(r[:, 1], first), np.full(len(first), len(first))])
    try:
        for together in (2, 30, 1 << 16):
            monkeypatch.setattr(procedural, "_TOGETHER", together)
            out = [tuple(r) for r in procedural._by_keys(rows.coalesce(1), ["image_id"], made, ["image_id bigint", "n int", "s bigint", "beside int"]).collect()]
            assert sorted(r[:3] for r in out) == [(k, k % 9 + 1, (k % 9) * (k % 9 + 1) // 2) for k in range(60)]
            assert max(r[3] for r in out) > 1
            assert together > 2 or max(r[3] for r in out) < 10
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

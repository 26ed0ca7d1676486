"""The image data source: headers, push-down, streams, and writing that leaves whole files or none."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from rasterloom.sources import files, image_files

SIZE = (37, 21)


def png(w=37, h=21, extra=0):
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return bytes.fromhex("89504E470D0A1A0A") + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes((w + 1) * h))) + chunk(b"IEND", b"") + bytes(extra)


def contents():
    w, h = SIZE
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 2000) + bytes(1998) + b"\xff\xdb" + struct.pack(">H", 67) + bytes(65) + b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, h, w, 3) + bytes(9)
    entries = [(256, 3, 1, w), (257, 4, 1, h)]
    tiffs = []
    for order, magic in (("<", b"II*\0"), (">", b"MM\0*")):
        body = struct.pack(order + "H", 2)
        for tag, kind, n, v in entries:
            body += struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", v, 0) if kind == 3 else struct.pack(order + "I", v))
        tiffs.append(magic + struct.pack(order + "I", 300) + bytes(292) + body)
    riff = lambda body: b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body
    return {
        "a.png": png(), "b.jpg": jpeg, "c.gif": b"GIF89a" + struct.pack("<HH", w, h) + bytes(9), "d.bmp": b"BM" + bytes(16) + struct.pack("<ii", w, -h) + bytes(30),
        "e.tif": tiffs[0], "f.tif": tiffs[1], "g.ico": b"\0\0\1\0" + struct.pack("<H", 2) + bytes([16, 16]) + bytes(14) + bytes([w, h]) + bytes(14),
        "h.webp": riff(b"VP8X" + struct.pack("<I", 10) + bytes(4) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")),
        "i.webp": riff(b"VP8L" + struct.pack("<I", 9) + b"\x2f" + ((w - 1) | (h - 1) << 14).to_bytes(4, "little") + bytes(4)),
        "j.webp": riff(b"VP8 " + struct.pack("<I", 20) + bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", w, h) + bytes(10)),
    }


def put(folder, found):
    for name, content in found.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def test_headers_of_all_formats(spark, tmp_path):
    put(tmp_path, contents() | {"k.txt": b"no image", "sub/l.png": png(5, 6), "_m/n.png": png(), ".o.png": png(), "p.jpg": b"\xff\xd8\xff\xe0\0\x10cut", "q.png": b""})
    rows = {os.path.relpath(r["path"], tmp_path): r for r in files.read_images(spark, str(tmp_path), headers=True).collect()}
    assert set(rows) == {*contents(), "sub/l.png", "p.jpg"}
    assert {n: (r["width"], r["height"]) for n, r in rows.items()} == {n: SIZE for n in contents()} | {"sub/l.png": (5, 6), "p.jpg": (None, None)}
    assert all(r["content"] is None and r["bytes"] == len((tmp_path / n).read_bytes()) for n, r in rows.items())
    assert rows["b.jpg"]["format"] == "JPEG" and rows["i.webp"]["format"] == "WEBP"


def test_contents_and_empty_folders(spark, tmp_path):
    put(tmp_path, contents())
    found = {os.path.basename(r["path"]): bytes(r["content"]) for r in files.read_images(spark, f"file://{tmp_path}").collect()}
    assert found == contents()
    assert files.read_images(spark, str(tmp_path / "none")).count() == 0


def test_only_wanted_files_are_read_beyond_their_header(tmp_path):
    """Filters on format and size are taken over by the source: bodies of other files are never read."""
    put(tmp_path, {"a.png": png(10, 10, 5_000_000), "b.png": png(900, 10, 5_000_000), "c.gif": b"GIF89a" + struct.pack("<HH", 9, 9) + bytes(5_000_000)})
    reader = image_files._Reader(str(tmp_path), True)
    pushed = [image_files.In(("format",), ("PNG", "BMP")), image_files.LessThan(("width",), 100), image_files.EqualTo(("path",), "x")]
    assert list(reader.pushFilters(pushed)) == pushed[2:]
    reads = []
    opened = image_files._opened

    class Store:
        def __init__(self, store):
            self.store = store

        def open_input_file(self, name):
            file = self.store.open_input_file(name)

            class File:
                __enter__ = lambda self: self
                __exit__ = lambda self, *a: file.close()
                read_at = lambda self, n, at: reads.append((os.path.basename(name), n)) or file.read_at(n, at)

            return File()

    parts = reader.partitions()
    image_files._opened = lambda path: (Store(opened(path)[0]), opened(path)[1])
    try:
        rows = [r for p in parts for r in reader.read(p)]
    finally:
        image_files._opened = opened
    assert [os.path.basename(r[0]) for r in rows] == ["a.png"] and len(rows[0][6]) > 5_000_000
    assert {n for n, size in reads if size > 64} == {"a.png"}


def test_filters_are_pushed_down_by_spark(spark, tmp_path):
    put(tmp_path, contents())
    found = files.read_images(spark, str(tmp_path), formats=["PNG", "TIFF"]).where("width < 100")
    assert sorted(os.path.basename(r["path"]) for r in found.collect()) == ["a.png", "e.tif", "f.tif"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(format" in plan.replace(" ", "") or "format" in plan


def test_partitions_hold_about_their_bytes():
    some = [(f"f{k}", 50 << 20, 0) for k in range(10)] + [("big", 1 << 40, 0)]
    parts = image_files._dealt(some, True)
    assert [len(p.files) for p in parts] == [2, 2, 2, 2, 2, 1]
    assert [len(p.files) for p in image_files._dealt(some, False)] == [11]


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"

    def run():
        query = (
            files.read_image_stream(spark, str(folder), headers=True).select("path", "width").writeStream.format("parquet")
            .option("checkpointLocation", f"file://{tmp_path}/state").option("path", f"file://{out}").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return sorted(os.path.basename(r["path"]) for r in spark.read.parquet(f"file://{out}").collect())

    put(folder, {"b.png": png(), "c.png": png()})
    for n, t in (("b.png", 1_000), ("c.png", 1_000)):
        os.utime(folder / n, (t, t))
    assert run() == ["b.png", "c.png"]
    put(folder, {"a.png": png(), "x/d.png": png(), "z.txt": b"-"})
    for n in ("a.png", "x/d.png", "z.txt"):
        os.utime(folder / n, (2_000, 2_000))
    assert run() == ["a.png", "b.png", "c.png", "d.png"] == run()


def pixels(spark, n=6):
    return spark.range(n).selectExpr("cast(id as int) image_id", "3 w", "2 h", "explode(sequence(0, 5)) i").selectExpr("image_id", "w", "h", "i % 3 x", "int(i / 3) y", "image_id * 7 + i b0")


def test_saved_images_are_read_back(spark, tmp_path):
    df = pixels(spark)
    files.save_images(df, str(tmp_path), "L")
    found = files.read_images(spark, str(tmp_path), ["PNG"]).withColumn("image_id", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("int"))
    assert sorted(map(tuple, files.load_pixels(found, "L").collect())) == sorted(map(tuple, df.collect()))
    files.save_images(df.where("image_id < 2"), str(tmp_path), "L")
    assert files.read_images(spark, str(tmp_path)).count() == 8
    files.save_images(df.where("image_id < 2"), str(tmp_path), "L", overwrite=True)
    assert files.read_images(spark, str(tmp_path)).count() == 2
    files.save_images(df.limit(0), str(tmp_path / "none"), "L")
    assert files.read_images(spark, str(tmp_path / "none")).count() == 0


def test_modes_that_a_format_does_not_hold_are_refused(spark, tmp_path):
    df = pixels(spark)
    for mode, kind in (("F", "PNG"), ("CMYK", "PNG"), ("L", "BMP"), ("L", "JPEG"), ("RGB", "PNG")):
        with pytest.raises(ValueError):
            files.save_images(df, str(tmp_path / "x"), mode, kind)
    assert not (tmp_path / "x").exists()


def test_failed_jobs_leave_nothing_and_repeated_tasks_once(spark, tmp_path):
    files.save_images(pixels(spark, 2), str(tmp_path), "L")
    before = sorted(p.name for p in tmp_path.rglob("*.png"))
    image_files.register(spark)
    rows = spark.range(0, 40, 1, 4).selectExpr("concat('n', id, '.png') name", "if(id = 37, null, binary('x')) content")
    with pytest.raises(Exception, match="needed"):
        rows.write.format(image_files.NAME).mode("append").save(str(tmp_path))
    assert sorted(os.path.basename(r["path"]) for r in files.read_images(spark, str(tmp_path), headers=True).collect()) == before
    # A task that ran twice, one run of which was lost: only the committed run's files are moved.
    writer = image_files._Writer(str(tmp_path / "two"), False)
    row = [{"name": "a.png", "content": b"1"}]
    lost, kept = writer.write(iter(row)), writer.write(iter(row))
    assert lost.folder != kept.folder
    writer.commit([kept, None, image_files._Written("empty", 0)])
    assert [p.name for p in (tmp_path / "two").rglob("*.png")] == ["a.png"] and not (tmp_path / "two/_staging").exists()
    with pytest.raises(ValueError):
        writer.write(iter(row * 2))
    for name in ("../x", "_x", ".x", None):
        with pytest.raises(ValueError):
            writer.write(iter([{"name": name, "content": b"1"}]))

"""Kinds of PNG and GIF files, EXIF blocks and float bytes, written here by other rules than the decoders'."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import geometry
from rasterloom.sources import codecs, files, pixels


def png(w, h, depth, colour, lines, interlaced=0, **chunks):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = b"".join(bytes([0]) + bytes(line) for line in lines)
    extra = b"".join(part(k.encode(), v) for k, v in chunks.items())
    return codecs.PNG_MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)) + extra + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def packed(values, depth):
    bits = "".join(f"{v:0{depth}b}" for v in values)
    bits += "0" * (-len(bits) % 8)
    return [int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)]


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
def test_png_of_few_bits_and_palettes(depth):
    rng = np.random.default_rng(depth)
    a = rng.integers(0, 1 << depth, (5, 11))
    w, h, n, grey = codecs.decode_png(png(11, 5, depth, 0, [packed(r, depth) for r in a]))
    assert (w, h, n) == (11, 5, 1) and np.array_equal(grey.reshape(5, 11), a * 255 // ((1 << depth) - 1))
    table = rng.integers(0, 256, (1 << depth, 3))
    _, _, n, rgb = codecs.decode_png(png(11, 5, depth, 3, [packed(r, depth) for r in a], PLTE=bytes(table.ravel().tolist())))
    assert n == 3 and np.array_equal(rgb.reshape(5, 11, 3), table[a])
    _, _, n, rgba = codecs.decode_png(png(11, 5, depth, 3, [packed(r, depth) for r in a], PLTE=bytes(table.ravel().tolist()), tRNS=bytes([7])))
    assert n == 4 and np.array_equal(rgba.reshape(5, 11, 4)[..., 3], np.where(a == 0, 7, 255))


def test_png_of_sixteen_bits_and_interlaced():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 65536, (3, 4))
    lines = [b"".join(struct.pack(">H", v) for v in r) for r in a.tolist()]
    assert codecs.decode_png(png(4, 3, 16, 0, lines))[3].tolist() == a.ravel().tolist()
    for w, h in ((13, 9), (1, 1), (3, 2), (8, 8)):
        b = rng.integers(0, 256, (h, w, 3))
        own = []
        for k in range(1, 8):  # pixels by the published order of passes in an 8 by 8 cell
            cell = ["16462646", "77777777", "56565656", "77777777", "36463646", "77777777", "56565656", "77777777"]
            rows = [[b[y, x] for x in range(w) if cell[y % 8][x % 8] == str(k)] for y in range(h)]
            own += [np.concatenate(r).tolist() for r in rows if r]
        assert np.array_equal(codecs.decode_png(png(w, h, 8, 2, own, 1))[3].reshape(h, w, 3), b)


def gif(w, h, index, table, interlaced=False, clear=None, least=8):
    codes, width = [1 << least], least + 1
    order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)] if interlaced else range(h)
    known = {bytes([k]): k for k in range(1 << least)}
    bits, fresh, word = f"{codes[0]:0{width}b}"[::-1], (1 << least) + 2, b""
    for v in (int(v) for y in order for v in index[y]):
        if word + bytes([v]) in known:
            word += bytes([v])
            continue
        bits += f"{known[word]:0{width}b}"[::-1]
        if fresh < 4096:
            known[word + bytes([v])] = fresh
            if fresh == 1 << width and width < 12:
                width += 1
            fresh += 1
        word = bytes([v])
    bits += f"{known[word]:0{width}b}"[::-1] + f"{(1 << least) + 1:0{width}b}"[::-1]
    data = bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    control = b"" if clear is None else b"!\xf9\x04" + bytes([1, 0, 0, clear]) + b"\0"
    blocks = b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255))
    return (b"GIF89a" + struct.pack("<HHBBB", w + 1, h, 0x80 | (least - 1), 0, 0) + bytes(table.ravel().tolist()) + control + b","
            + struct.pack("<HHHHB", 1, 0, w, h, 0x40 if interlaced else 0) + bytes([least]) + blocks + b"\0;")


@pytest.mark.parametrize("interlaced,clear,least", [(False, None, 8), (True, 3, 8), (False, 1, 2)])
def test_gif(interlaced, clear, least):
    rng = np.random.default_rng(5)
    index, table = rng.integers(0, 1 << least, (61, 90)), rng.integers(0, 256, (1 << least, 3))
    index[20:40] = 2  # long runs
    w, h, n, out = codecs.decode_gif(gif(90, 61, index, table, interlaced, clear, least))
    out = out.reshape(h, w, n)
    assert (w, h, n) == (91, 61, 3 if clear is None else 4)
    assert np.array_equal(out[:, 1:, :3], table[index])
    if clear is not None:
        assert np.array_equal(out[:, 1:, 3], np.where(index == clear, 0, 255)) and (out[:, 0, 3] == 0).all()
    with pytest.raises((ValueError, IndexError)):
        codecs.decode_gif(gif(90, 61, index, table, interlaced, clear, least)[:200])


def block(order, orientation):
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HIHHHIHHI", 42, 8, 1, 274, 3, 1, orientation, 0, 0)


def test_exif_turns_images_and_errors_are_rows(spark):
    a = np.arange(6).reshape(2, 3)
    plain = png(3, 2, 8, 0, a.tolist())
    turned = png(3, 2, 8, 0, a.tolist(), eXIf=block(">", 6))
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", 2 + 6 + len(block("<", 8))) + b"Exif\0\0" + block("<", 8) + b"\xff\xda"
    rows = [(1, plain), (2, turned), (3, jpeg), (4, plain[:-30]), (5, png(3, 2, 8, 2, [[1] * 9] * 2)), (6, None), (7, b"text")]
    found = files.describe(spark.createDataFrame(rows, "image_id bigint, content binary"))
    assert {r["image_id"]: r["orientation"] for r in files.orientations(found).collect()} == {1: 1, 2: 6, 3: 8, 4: 1, 5: 1}
    assert {r["image_id"]: bytes(r["exif"]) for r in files.exif(found).where("exif is not null").collect()} == {2: block(">", 6), 3: block("<", 8)}
    loaded = files.load_pixels(found, "L")
    assert {r["image_id"] for r in files.undecodable(found, "L").collect()} == {3, 4, 5}
    assert {r["image_id"] for r in loaded.collect()} == {1, 2}
    out = {(r["image_id"], r["x"], r["y"]): r["b0"] for r in geometry.exif_transpose(loaded, files.orientations(found)).collect()}
    assert [[out[2, x, y] for x in range(2)] for y in range(3)] == np.rot90(a, -1).tolist()
    assert [[out[1, x, y] for x in range(3)] for y in range(2)] == a.tolist()


def test_float_and_sixteen_bit_bytes(spark):
    values = np.array([0.1, -2.5e20, 3.0, float("inf"), 0.0, 1e-30], "<f4")
    df = pixels.from_bytes(spark.createDataFrame([(1, values.tobytes())], "image_id bigint, d binary"), "d", "F", (3, 2))
    assert df.orderBy("y", "x").select("b0").toPandas()["b0"].to_numpy(np.float32).tolist() == values.tolist()
    assert bytes(pixels.to_bytes(df, "F").first()["data"]) == values.tobytes()
    whole = np.array([0, 1, 255, 256, 65535, 4660], "<u2")
    df = pixels.from_bytes(spark.createDataFrame([(1, whole.tobytes())], "image_id bigint, d binary"), "d", "I;16", (2, 3))
    assert bytes(pixels.to_bytes(df, "I;16").first()["data"]) == whole.tobytes()
    assert df.agg(F.sum("b0")).first()[0] == int(whole.astype(int).sum())

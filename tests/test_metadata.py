"""EXIF directories, XMP and text chunks of files made by hand."""

import struct
import zlib

import pytest

from rasterloom.sources import metadata


def block(order, directories):
    """A TIFF structure: directories are lists of (tag, kind, values or bytes or ("at", name)), by name; "thumbnail" follows "image"."""
    formats = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
    starts, at = {}, 8
    for name, entries in directories.items():
        starts[name] = at
        at += 6 + 12 * len(entries)
    out, tail = {}, b""
    for name, entries in directories.items():
        raw = struct.pack(order + "H", len(entries))
        for tag, kind, values in entries:
            if isinstance(values, tuple) and values[0] == "at":
                values = [starts[values[1]]]
            if kind in (5, 10):
                data, count = b"".join(struct.pack(order + ("II" if kind == 5 else "ii"), *v) for v in values), len(values)
            elif isinstance(values, bytes):
                data, count = values, len(values)
            else:
                data, count = struct.pack(order + formats[kind] * len(values), *values), len(values)
            raw += struct.pack(order + "HHI", tag, kind, count)
            if len(data) <= 4:
                raw += data.ljust(4, b"\0")
            else:
                raw += struct.pack(order + "I", at + len(tail))
                tail += data
        out[name] = raw + struct.pack(order + "I", starts.get("thumbnail", 0) if name == "image" else 0)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + b"".join(out.values()) + tail


TREE = {
    "image": [(270, 2, b"a caf\xe9\0rest"), (274, 3, [6]), (282, 5, [(72, 1), (4000000000, 7)]), (34665, 4, ("at", "exif")), (34853, 4, ("at", "gps")), (700, 7, b"\1\2\3\4\5")],
    "thumbnail": [(259, 3, [6])],
    "exif": [(34855, 3, [100, 200, 300]), (37380, 10, [(-1, 3)]), (40965, 4, ("at", "interop")), (37121, 7, b"\1\2\3\0")],
    "gps": [(2, 5, [(52, 1), (30, 1), (1, 2)]), (1, 2, b"N\0")],
    "interop": [(1, 2, b"R98\0"), (9, 9, [-5, 7]), (8, 8, [-2]), (6, 6, [-3, 4]), (5, 1, [250])],
}


@pytest.mark.parametrize("order", "<>")
def test_all_directories_are_walked(spark, order):
    df = spark.createDataFrame([(1, bytearray(block(order, TREE)))], "image_id int, exif binary")
    found = {(r["directory"], r["tag"]): r for r in metadata.exif_entries(df).collect()}
    assert set(found) == {(d, e[0]) for d, entries in TREE.items() for e in entries}
    text = lambda d, t: found[d, t]["text"]
    assert (text("image", 270), text("gps", 1), text("interop", 1)) == ("a café", "N", "R98")
    assert found["exif", 34855]["whole"] == [100, 200, 300] and found["interop", 9]["whole"] == [-5, 7] and found["interop", 6]["whole"] == [-3, 4]
    assert found["interop", 8]["whole"] == [-2] and found["interop", 5]["whole"] == [250] and found["thumbnail", 259]["whole"] == [6]
    pairs = lambda d, t: [tuple(x) for x in found[d, t]["ratio"]]
    assert pairs("image", 282) == [(72, 1), (4000000000, 7)] and pairs("exif", 37380) == [(-1, 3)] and pairs("gps", 2) == [(52, 1), (30, 1), (1, 2)]
    assert bytes(found["image", 700]["raw"]) == b"\1\2\3\4\5"
    assert [tuple(r) for r in metadata.orientation_of(df).collect()] == [(1, 6)]
    assert ("image", 274) not in {(r["directory"], r["tag"]) for r in metadata.after_transpose(metadata.exif_entries(df)).collect()}


def test_damaged_blocks(spark):
    whole = block("<", TREE)
    loop = b"II*\0" + struct.pack("<I", 8) + struct.pack("<HHHII", 1, 34665, 4, 1, 8) + struct.pack("<I", 8)
    rows = [None, b"", b"II*\0", b"XX*\0" + whole[4:], b"II*\0" + struct.pack("<I", 10**9), whole[:60], loop, b"II*\0" + struct.pack("<IHHHII", 8, 1, 270, 2, 2**31, 8)]
    df = spark.createDataFrame([(k, v and bytearray(v)) for k, v in enumerate(rows)] + [(9, bytearray(whole))], "image_id int, exif binary")
    found = metadata.exif_entries(df).collect()
    assert {r["image_id"] for r in found} == {5, 6, 7, 9} and all(r["text"] is None for r in found if r["image_id"] == 7)
    assert len([r for r in found if r["image_id"] == 6]) == 3  # itself, as its own next one and as its own sub-directory
    assert {r["image_id"]: r["orientation"] for r in metadata.orientation_of(df).collect()} == {k: 6 if k in (5, 9) else 1 for k in range(len(rows))} | {9: 6}


PACKET = """<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="r">
<rdf:Description rdf:about="" xmlns:dc="d" xmp:Rating="4" tiff:Make='A &amp; B'><dc:format>image/jpeg</dc:format>
<dc:subject><rdf:Bag><rdf:li>one</rdf:li><rdf:li xml:lang="x">zwöi &lt;2&gt;</rdf:li></rdf:Bag></dc:subject></rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>"""


def test_xmp(spark):
    rows = [(1, b"\xff\xd8\xff\xe1\0\0http://ns.adobe.com/xap/1.0/\0" + PACKET.encode() + b"\xff\xd9"), (2, b"none"), (3, None)]
    packets = metadata.xmp(spark.createDataFrame([(k, v and bytearray(v)) for k, v in rows], "image_id int, content binary"))
    found = {r["image_id"]: r["xmp"] for r in packets.collect()}
    assert found[1].startswith("<x:xmpmeta") and found[1].endswith("</x:xmpmeta>") and found[2] is None and found[3] is None
    assert {r["property"]: r["values"] for r in metadata.xmp_properties(packets).collect()} == {
        "xmp:Rating": ["4"], "tiff:Make": ["A & B"], "dc:format": ["image/jpeg"], "dc:subject": ["one", "zwöi <2>"]}


def test_info(spark):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    texts = [(b"tEXt", b"Author\0caf\xe9"), (b"zTXt", b"Long\0\0" + zlib.compress(b"x" * 5000)), (b"iTXt", "Title\0\0\0de\0Titel\0Grüße".encode()), (b"iTXt", b"Deep\0\1\0\0\0" + zlib.compress(b"deep"))]
    texts += [(b"tEXt", b"Author\0last"), (b"pHYs", struct.pack(">IIB", 11811, 11811, 1)), (b"gAMA", struct.pack(">I", 45455))]
    png = bytes.fromhex("89504E470D0A1A0A") + b"".join(chunk(*t) for t in texts) + chunk(b"IEND", b"") + chunk(b"tEXt", b"after\0end")
    cut = png[:40]
    df = spark.createDataFrame([(1, bytearray(png)), (2, bytearray(b"GIF89a")), (3, None), (4, bytearray(cut))], "image_id int, content binary")
    found = {r["image_id"]: r["info"] for r in metadata.info(df).collect()}
    assert found[1] == {"Author": "last", "Long": "x" * 5000, "Title": "Grüße", "Deep": "deep", "dpi": "299.999,299.999", "gamma": "0.45455"}
    assert found[2] == found[3] == {} and found[4] == {"Author": "café"}

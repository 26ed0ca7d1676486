"""Decoders and encoders of single files, in numpy. Each decoder gives (w, h, bands, samples) or raises."""

from __future__ import annotations

import struct
import zlib

import numpy as np

PNG_MAGIC = bytes.fromhex("89504E470D0A1A0A")
Image = tuple[int, int, int, np.ndarray]
#: First column, first row, steps across and down of the passes of an interlaced PNG.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png_chunks(content: bytes) -> dict[bytes, bytes]:
    """Kind -> data of a PNG's chunks, those of one kind put together."""
    if content[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, found = 8, {}
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        data = content[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("bad checksum")
        found[kind] = found.get(kind, b"") + data
        at += 12 + size
    return found


def _unfiltered(raw: np.ndarray, rows: int, line: int, step: int) -> np.ndarray:
    """Rows of bytes of a PNG with their filters undone; step is the bytes from a pixel to the next."""
    coded = raw[: rows * (line + 1)].reshape(rows, line + 1)
    out, above = np.zeros((rows, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(rows):
        kind, now = coded[y, 0], coded[y, 1:].copy()
        if kind == 1:
            for k in range(step):
                now[k::step] = np.add.accumulate(now[k::step], dtype=np.uint8)
        elif kind == 2:
            now += above
        elif kind in (3, 4):
            for i in range(line):
                left, up, corner = (int(now[i - step]) if i >= step else 0), int(above[i]), (int(above[i - step]) if i >= step else 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v: abs(p - v))  # noqa: B023
                now[i] = (int(now[i]) + guess) & 255
        elif kind:
            raise ValueError("bad filter")
        out[y] = above = now
    return out


def _samples(lines: np.ndarray, w: int, n: int, depth: int) -> np.ndarray:
    """(rows, w, n) samples of packed lines."""
    if depth == 16:
        return lines.view(">u2").astype(np.int64).reshape(len(lines), w, n)
    if depth == 8:
        return lines.astype(np.int64).reshape(len(lines), w, n)
    bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
    return (bits.astype(np.int64) << np.arange(depth - 1, -1, -1)).sum(axis=2)[:, : w * n].reshape(len(lines), w, n)


def decode_png(content: bytes) -> Image:
    """Any depth, with a palette or without, interlaced or not. Palette colours become RGB, or RGBA where some are
    transparent; 16-bit grey stays, colour of 16 bits keeps its upper eight; grey of few bits is spread to 0..255."""
    chunks = png_chunks(content)
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw, step = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8), max(1, n * depth // 8)
    line = lambda width: (width * n * depth + 7) // 8
    if interlaced:
        out, at = np.zeros((h, w, n), np.int64), 0
        for x0, y0, dx, dy in _PASSES:
            own_w, own_h = -(-(w - x0) // dx), -(-(h - y0) // dy)
            if own_w > 0 and own_h > 0:
                out[y0::dy, x0::dx] = _samples(_unfiltered(raw[at:], own_h, line(own_w), step), own_w, n, depth)
                at += own_h * (line(own_w) + 1)
    else:
        out = _samples(_unfiltered(raw, h, line(w), step), w, n, depth)
    if colour == 3:
        palette = np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3).astype(np.int64)
        if b"tRNS" in chunks:
            alpha = np.full(len(palette), 255, np.int64)
            alpha[: len(chunks[b"tRNS"])] = np.frombuffer(chunks[b"tRNS"], np.uint8)[: len(alpha)]
            palette = np.column_stack([palette, alpha])
        out = palette[out[..., 0]]
    elif depth < 8:
        out = out * 255 // ((1 << depth) - 1)
    elif depth == 16 and n > 1:
        out >>= 8
    return w, h, out.shape[2], out.ravel()


def encode_png(w: int, h: int, n: int, samples: np.ndarray) -> bytes:
    rows = np.concatenate([np.zeros((h, 1), np.uint8), samples.reshape(h, w * n).astype(np.uint8)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _codes(data: bytes, least: int) -> bytes:
    """What GIF's variable-length codes stand for; codes begin at one bit more than ``least``."""
    clear, end = 1 << least, (1 << least) + 1
    table: list[bytes] = []
    out, width, bits, held, last = [], least + 1, 0, 0, b""
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code, held, bits = held & ((1 << width) - 1), held >> width, bits - width
            if code == clear:
                table, width, last = [bytes([k]) for k in range(clear)] + [b"", b""], least + 1, b""
                continue
            if code == end:
                return b"".join(out)
            if code < len(table):
                now = table[code]
            elif code == len(table) and last:
                now = last + last[:1]
            else:
                raise ValueError("bad code")
            if last and len(table) < 4096:
                table.append(last + now[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
            out.append(now)
            last = now
    return b"".join(out)


def decode_gif(content: bytes) -> Image:
    """The first frame on its canvas, as RGB, or as RGBA where a colour is transparent."""
    if content[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    w, h, flags, background = struct.unpack("<HHBB", content[6:12])
    at, clear, table = 13, None, b""
    if flags & 128:
        size = 3 << (flags % 8 + 1)
        table, at = content[at : at + size], at + size

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while content[at]:
            parts.append(content[at + 1 : at + 1 + content[at]])
            at += 1 + content[at]
        return b"".join(parts), at + 1

    while content[at] != 0x2C:
        if content[at] != 0x21:
            raise ValueError("no frame")
        label = content[at + 1]
        data, at = blocks(at + 2)
        if label == 0xF9 and data[0] & 1:
            clear = data[3]
    x0, y0, fw, fh, flags = struct.unpack("<HHHHB", content[at + 1 : at + 10])
    at += 10
    if flags & 128:
        size = 3 << (flags % 8 + 1)
        table, at = content[at : at + size], at + size
    data, _ = blocks(at + 1)
    index = np.frombuffer(_codes(data, content[at]), np.uint8)
    if len(index) < fw * fh or not table:
        raise ValueError("the frame ends early")
    rows = index[: fw * fh].reshape(fh, fw)
    if flags & 64:  # every eighth row, those between, and so on
        order = [*range(0, fh, 8), *range(4, fh, 8), *range(2, fh, 4), *range(1, fh, 2)]
        rows = rows[np.argsort(order)]
    canvas = np.full((h, w), background if clear is None else clear, np.int64)
    canvas[y0 : y0 + fh, x0 : x0 + fw] = rows[: h - y0, : w - x0]
    palette = np.zeros((256, 3), np.int64)
    colours = np.frombuffer(table, np.uint8).reshape(-1, 3)
    palette[: len(colours)] = colours
    if clear is not None:
        palette = np.column_stack([palette, np.where(np.arange(256) == clear, 0, 255)])
    out = palette[canvas]
    return w, h, out.shape[2], out.ravel()


def decode_bmp(content: bytes) -> tuple[int, int, int, np.ndarray]:
    """(w, h, bands, samples) of an uncompressed 24- or 32-bit BMP."""
    offset, = struct.unpack("<I", content[10:14])
    w, h, _, bits, packing = struct.unpack("<iiHHI", content[18:34])
    n = bits // 8
    if content[:2] != b"BM" or n not in (3, 4) or packing not in (0, 3):
        raise ValueError("only uncompressed 24- and 32-bit BMP")
    line = (w * n + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, line * abs(h), offset).reshape(abs(h), line)[:, : w * n].reshape(abs(h), w, n)
    rows = (rows[::-1] if h > 0 else rows)[:, :, [2, 1, 0, 3][:n]]
    return w, abs(h), n, rows.ravel()


def encode_bmp(w: int, h: int, n: int, samples: np.ndarray) -> bytes:
    if n not in (3, 4):
        raise ValueError("BMP files hold RGB or RGBA")
    rows = samples.reshape(h, w, n).astype(np.uint8)[::-1, :, [2, 1, 0, 3][:n]].reshape(h, w * n)
    data = np.pad(rows, ((0, 0), (0, -w * n % 4))).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(data), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 * n, 0, len(data), 0, 0, 0, 0) + data


def exif_of(content: bytes | None) -> bytes | None:
    """The EXIF block (a TIFF structure) of a JPEG, PNG or TIFF file, if it has one."""
    if content is None:
        return None
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    if content[:8] == PNG_MAGIC:
        return png_chunks(content).get(b"eXIf")
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xD9, 0xDA):
        size, = struct.unpack(">H", content[at + 2 : at + 4])
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return content[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def exif_tags(block: bytes | None) -> dict[int, int]:
    """Tag -> value of the whole numbers (16 and 32 bits, one each) in an EXIF block's first directory."""
    if not block or block[:2] not in (b"II", b"MM"):
        return {}
    order = "<" if block[:2] == b"II" else ">"
    at, = struct.unpack(order + "I", block[4:8])
    count, = struct.unpack(order + "H", block[at : at + 2])
    found = {}
    for k in range(count):
        entry = block[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if n == 1 and kind in (3, 4):
            found[tag], = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])
    return found


DECODERS = {"PNG": decode_png, "BMP": decode_bmp, "GIF": decode_gif}
ENCODERS = {"PNG": encode_png, "BMP": encode_bmp}

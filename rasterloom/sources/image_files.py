"""Folders of image files as a Spark data source ("rasterloom_images"): batch and stream reading, and writing.

Reading gives (path, format, width, height, bytes, modified, content). A file is looked at only as far as it is needed: its
header first, and the rest only if the format and size are wanted (filters on those columns are pushed down here) and
the option ``headers`` is not set. Partitions are files of about 128 MB together. A stream takes the files
that are new since the last batch, by time of change, then path: files have to be moved into the folder whole.

Writing takes (name, content) rows. A task writes its files into a folder of its own under ``_staging``; when
the job commits, each committed task's folder is moved next to the others, one move a task; folders of failed,
repeated or lost tasks are never moved and go with ``_staging`` (what a task still writes after its job was given up stays
there, unseen). Readers pass over names that begin with ``_`` or a dot.

Paths are whatever pyarrow.fs opens: local ones, hdfs, s3, gs.

Edge cases: an empty folder, or none, is an empty table. Files whose first bytes are of no known format are left out; a
header that is cut short has null sizes. Null names and contents are refused. Two rows of a task with one name are
refused, those of different tasks are in different folders.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..shipping import ship

NAME = "rasterloom_images"
SCHEMA = "path string, format string, width int, height int, bytes bigint, modified timestamp, content binary"
PARTITION_BYTES, OPEN_COST = 128 << 20, 4 << 20
_STAGING = "_staging"
#: Bytes that are read first; JPEG and TIFF may say where to go on.
_HEAD = 64


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# --- headers -----------------------------------------------------------------------------------------------

Read = Callable[[int, int], bytes]


def _jpeg(read: Read) -> tuple[int, int]:
    """The size in the frame header, reached from segment to segment."""
    at = 2
    while True:
        mark, kind, size = struct.unpack(">BBH", read(at, 4))
        if mark != 0xFF:
            raise ValueError("no marker")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", read(at + 5, 4))
            return w, h
        at += 2 + size


def _tiff(read: Read) -> tuple[int, int]:
    order = "<" if read(0, 2) == b"II" else ">"
    at, = struct.unpack(order + "I", read(4, 4))
    count, = struct.unpack(order + "H", read(at, 2))
    entries = read(at + 2, 12 * count)
    found = {}
    for k in range(count):
        tag, kind = struct.unpack_from(order + "HH", entries, 12 * k)
        if tag in (256, 257):
            found[tag], = struct.unpack_from(order + ("H" if kind == 3 else "I"), entries, 12 * k + 8)
    return found[256], found[257]


def _webp(read: Read) -> tuple[int, int]:
    kind = read(12, 4)
    if kind == b"VP8X":
        raw = read(24, 6)
        return 1 + int.from_bytes(raw[:3], "little"), 1 + int.from_bytes(raw[3:], "little")
    if kind == b"VP8L":
        bits = int.from_bytes(read(21, 4), "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    w, h = struct.unpack("<HH", read(26, 4))
    return w & 0x3FFF, h & 0x3FFF


def _ico(read: Read) -> tuple[int, int]:
    """The largest image of the directory."""
    count, = struct.unpack("<H", read(4, 2))
    entries = read(6, 16 * count)
    return max(((entries[k] or 256, entries[k + 1] or 256) for k in range(0, 16 * count, 16)), key=lambda s: s[0] * s[1])


def _fixed(layout: str, at: int) -> Callable[[Read], tuple[int, int]]:
    def size(read: Read) -> tuple[int, int]:
        w, h = struct.unpack(layout, read(at, struct.calcsize(layout)))
        return w, abs(h)

    return size


#: Format, its first bytes, how its size is read.
FORMATS = (
    ("PNG", bytes.fromhex("89504E470D0A1A0A"), _fixed(">II", 16)),
    ("JPEG", b"\xff\xd8\xff", _jpeg),
    ("GIF", b"GIF87a", _fixed("<HH", 6)),
    ("GIF", b"GIF89a", _fixed("<HH", 6)),
    ("BMP", b"BM", _fixed("<ii", 18)),
    ("TIFF", b"II*\0", _tiff),
    ("TIFF", b"MM\0*", _tiff),
    ("ICO", b"\0\0\1\0", _ico),
    ("WEBP", b"RIFF", _webp),
)


def header(head: bytes, more: Read) -> tuple[str | None, int | None, int | None]:
    """(format, width, height) by a file's first bytes; ``more(at, n)`` reads n bytes, all or an error, where those end."""
    read = lambda at, n: head[at : at + n] if at + n <= len(head) else more(at, n)
    for name, magic, size in FORMATS:
        if head.startswith(magic) and (name != "WEBP" or head[8:12] == b"WEBP"):
            try:
                return name, *size(read)
            except (ValueError, KeyError, EOFError, struct.error):
                return name, None, None
    return None, None, None


# --- reading -----------------------------------------------------------------------------------------------


@dataclass
class _Files(InputPartition):
    """(path, bytes, time of change in microseconds) of some files."""

    files: Sequence[tuple[str, int, int]]


def _listed(path: str) -> list[tuple[str, int, int]]:
    store, root = _opened(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = lambda p: any(part[:1] in ("_", ".") for part in posixpath.relpath(p, root).split("/"))
    return sorted(((f.path, f.size, (f.mtime_ns or 0) // 1000) for f in found if f.type == fs.FileType.File and not hidden(f.path)), key=lambda f: f[0])


def _dealt(files: Sequence[tuple[str, int, int]], whole: bool) -> list[_Files]:
    parts: list[_Files] = []
    room = 0
    for file in files:
        cost = OPEN_COST + (file[1] if whole else 0)
        if cost > room:
            parts.append(_Files([]))
            room = PARTITION_BYTES
        parts[-1].files.append(file)
        room -= cost
    return parts


_TESTS = {
    EqualTo: lambda v, f: v == f.value, In: lambda v, f: v in f.value, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value,
}
_PUSHED = ("format", "width", "height", "bytes")


def _rows(path: str, files: Sequence[tuple[str, int, int]], filters: Sequence[Filter], whole: bool) -> Iterator[tuple]:
    from datetime import datetime, timezone

    store, _ = _opened(path)
    for name, size, changed in files:
        with store.open_input_file(name) as file:

            def more(at: int, n: int, file=file) -> bytes:
                raw = file.read_at(n, at)
                if len(raw) < n:
                    raise EOFError
                return raw

            kind, w, h = header(file.read_at(min(_HEAD, size), 0), more)
            seen = {"format": kind, "width": w, "height": h, "bytes": size}
            value = lambda f: seen[f.attribute[0]]  # noqa: B023, E731
            if kind is None or not all(value(f) is not None and _TESTS[type(f)](value(f), f) for f in filters):
                continue
            content = file.read_at(size, 0) if whole else None
            yield name, kind, w, h, size, datetime.fromtimestamp(changed / 1e6, timezone.utc), content


class _Reader(DataSourceReader):
    def __init__(self, path: str, whole: bool):
        self.path, self.whole, self.filters = path, whole, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return _dealt(_listed(self.path), self.whole)

    def read(self, partition: _Files | None) -> Iterator[tuple]:
        return _rows(self.path, partition.files if partition else [], self.filters, self.whole)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the last file that counts: its time of change and path."""

    def __init__(self, path: str, whole: bool):
        self.path, self.whole = path, whole

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((changed, name) for name, _, changed in _listed(self.path)), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        lo, hi = (start["changed"], start["path"]), (end["changed"], end["path"])
        return _dealt([f for f in _listed(self.path) if lo < (f[2], f[0]) <= hi], self.whole)

    def read(self, partition: _Files | None) -> Iterator[tuple]:
        return _rows(self.path, partition.files if partition else [], [], self.whole)


# --- writing -----------------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    """The folder of a task's files, and how many they are."""

    folder: str
    count: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> _Written:
        store, root = _opened(self.path)
        folder = f"{uuid.uuid4().hex}"
        place = posixpath.join(root, _STAGING, self.job, folder)
        names: set[str] = set()
        for row in iterator:
            if row["name"] is None or row["content"] is None:
                raise ValueError("a name and a content are needed")
            if row["name"] in names or "/" in row["name"] or row["name"][:1] in ("_", "."):
                raise ValueError(f"not a name of its own: {row['name']!r}")
            if not names:
                store.create_dir(place, recursive=True)
            names.add(row["name"])
            with store.open_output_stream(posixpath.join(place, row["name"])) as file:
                file.write(row["content"])
        return _Written(folder, len(names))

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = _opened(self.path)
        kept = [m.folder for m in messages if m is not None and m.count]
        if self.overwrite:
            found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
            for old in found:
                if old.type == fs.FileType.Directory and old.base_name != _STAGING:
                    store.delete_dir(old.path)
                elif old.type == fs.FileType.File:
                    store.delete_file(old.path)
        for folder in kept:
            store.move(posixpath.join(root, _STAGING, self.job, folder), posixpath.join(root, f"part-{folder}"))
        self._clear(store, root)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(posixpath.join(root, "_SUCCESS")) as file:
            file.write(json.dumps({"parts": len(kept), "files": sum(m.count for m in messages if m is not None)}).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        own = posixpath.join(root, _STAGING, self.job)
        if store.get_file_info(own).type == fs.FileType.Directory:
            store.delete_dir(own)
        staging = posixpath.join(root, _STAGING)
        if store.get_file_info(staging).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(staging)):
            store.delete_dir(staging)


class ImageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _whole(self) -> bool:
        return self.options.get("headers", "false").lower() != "true"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._whole())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self._whole())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if {"name", "content"} - set(schema.names):
            raise ValueError("columns name and content are written")
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed down, and its workers find this package."""
    ship(spark)
    spark.dataSource.register(ImageFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

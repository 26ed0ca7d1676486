"""Byte-level BPE encoding and decoding over overlapping chunks.

A text longer than a chunk is cut into chunks that overlap. Each chunk is pre-tokenised on its own, from its own
first character. Two neighbours are stitched at the first place in their overlap
where both have a pre-token boundary that does not follow white space: the pattern looks only ahead,
and past white space only, so from there on both agree and what is before stays as it was.
The pieces between stitches are encoded on their own, and their ids put together in order. Where chunks do not
resynchronise in an overlap (one pre-token longer than it), the rest of the text is one piece.

Cutting is done twice. A text of many chunks is cut into sections first, of ``spread`` chunks each, which overlap and are
stitched in the same way; its sections go to different tasks. The chunks of a section, or of a text that is no longer than
one, are stitched inside a task. A text is cut in one pass, and a piece is cut from its own section, so the work grows with
a text's length alone. A text whose sections do not resynchronise is one section.

Edge cases: a null text counts as empty, an empty text has no ids; an empty table has an empty result. Repeated rows, null ids and extra
columns pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .staging import bounded_batches, staged

#: A boundary this near a chunk's end may move when more text follows.
_MARGIN = 4
#: Rows that go through a worker together.
_SLICE = 256


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


@lru_cache(maxsize=4)
def _pieces(path: str) -> np.ndarray:
    ranks = _ranks(path)
    table = np.empty(max(ranks.values(), default=-1) + 1, object)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Where pre-tokens start, and the text's end."""
    return np.fromiter((m.start() for m in _splitter(pattern).finditer(text)), np.int64, -1)


def _ends(t: str, pattern: str, size: int, overlap: int, last: bool) -> tuple[list[int], list[int]]:
    """Boundaries that t, a chunk, can be stitched at: in the overlap with the chunk before, and in that with the next one,
    counted from the next one's start."""
    found = boundaries(t, pattern)
    if not last:
        found = found[found < len(t) - _MARGIN]
    # After white space no cut: the pattern looks one character past a run of it.
    firm = lambda some: [p for p in some.tolist() if not (p and t[p - 1].isspace())]
    return firm(found[found < overlap]), [] if last else [p - size for p in firm(found[found >= size])]


def pieces(text: str, pattern: str, size: int, overlap: int) -> list[str]:
    """The text, cut where its neighbouring chunks resynchronise."""
    if len(text) <= size:
        return [text]
    out, at, n, tail = [], 0, -(-len(text) // size), []
    for k in range(n):
        head, own = _ends(text[k * size : (k + 1) * size + overlap], pattern, size, overlap, k == n - 1)
        if k:
            both = set(tail).intersection(head)
            if not both:
                break  # nothing is known of where this chunk's pre-tokens begin
            out.append(text[at : (at := k * size + min(both))])
        tail = own
    return [*out, text[at:]]


def _mapped(df: DataFrame, column: str, to: dict[str, Callable[[list], list[bytes]]], drop: Sequence[str] = ()) -> DataFrame:
    """df without the columns to drop, and with those named by ``to``: the first function's is of lists of the column's values,
    each further one's of the list before it. Rows go through in small slices, so that a worker holds the results of a few
    hundred texts at most."""
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in to and c not in drop]
    at, keep = df.columns.index(column), [df.columns.index(c) for c in kept]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                part = batch.slice(start, _SLICE)
                values, made = part.column(at).to_pylist(), []
                for fn in to.values():
                    values = fn(values)
                    made.append(pa.array(values, pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *made], names=[*kept, *to])

    schema = StructType([df.schema[c] for c in kept] + [StructField(c, BinaryType()) for c in to])
    return df.mapInArrow(rows, schema)


class ByteBPE:
    """Encoder and decoder for the ranks in the file at ``path``, which every executor can open."""

    def __init__(self, path: str, pattern: str, chunk: int = 1_024, overlap: int = 128, spread: int = 32):
        if not _MARGIN < overlap < chunk:
            raise ValueError("overlap must be shorter than a chunk")
        self.path, self.pattern, self.chunk, self.overlap, self.section = path, pattern, chunk, overlap, chunk * spread

    def _ids(self) -> Callable[[list], list[bytes]]:
        """Ids of texts, whose chunks are stitched and whose pieces are encoded inside a task."""
        path, pattern, size, overlap = self.path, self.pattern, self.chunk, self.overlap

        def ids(texts: list[str | None]) -> list[bytes]:
            encode = _encoding(path, pattern).encode_ordinary
            return [b"".join(np.array(encode(piece), "<u4").tobytes() for piece in pieces(t or "", pattern, size, overlap)) for t in texts]

        return ids

    def _raw(self) -> Callable[[list], list[bytes]]:
        """The tokens' raw bytes put together, of ids."""
        path = self.path

        def raw(series: list[bytes | None]) -> list[bytes]:
            table = _pieces(path)
            return [b"".join(table[np.frombuffer(x or b"", "<u4")].tolist()) for x in series]

        return raw

    def _parted(self, df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
        """Rows whose text is a section at most, and those whose text is longer."""
        return df.where(F.coalesce(F.length(text), F.lit(0)) <= self.section), df.where(F.length(text) > self.section)

    def encode(self, df: DataFrame, text: str = "text", to: str = "ids") -> DataFrame:
        """df with the column named by ``to``: the ids as little-endian unsigned 32-bit integers."""
        whole, long = self._parted(df, text)
        return _mapped(whole, text, {to: self._ids()}).unionByName(self._stitched(long, text, to))

    def round_trip(self, df: DataFrame, text: str = "text", to: str = "ids", back: str = "decoded", drop: Sequence[str] = ()) -> DataFrame:
        """As decode(encode(df)), without the columns to drop. One Python worker of a task does both; one after the other
        they are two, and an executor keeps twice as many."""
        whole, long = self._parted(df, text)
        coded = self._stitched(long, text, to)
        return _mapped(whole, text, {to: self._ids(), back: self._raw()}, drop).unionByName(_mapped(coded, to, {back: self._raw()}, drop))

    def _stitched(self, long: DataFrame, text: str, to: str) -> DataFrame:
        size, overlap, pattern = self.section, self.overlap, self.pattern
        # Rows get a number once, in a table, so that a recomputed task cannot number them anew.
        rows = staged(long.select(F.struct("*").alias("__row")).withColumn("__key", F.monotonically_increasing_id()), "bpe-long")
        body = F.col("__row").getField(text)

        def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, t in zip(batch["__key"].to_pylist(), batch["t"], strict=True):
                    t = t.as_py()
                    n = -(-len(t) // size)
                    for at in range(0, n, 64):  # a text's sections leave in parts
                        ks = range(at, min(n, at + 64))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key] * len(ks)), pa.array(ks, pa.int32()), pa.array([n] * len(ks), pa.int32()), pa.array([t[k * size : (k + 1) * size + overlap] for k in ks])],
                            names=["__key", "k", "n", "t"])

        sections = rows.select("__key", body.alias("t")).mapInArrow(sliced, "__key bigint, k int, n int, t string")

        def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                heads, tails = [], []
                for k, n, t in zip(frame["k"], frame["n"], frame["t"], strict=True):
                    head, tail = _ends(t, pattern, size, overlap, k == n - 1)
                    heads.append(head if k else [])
                    tails.append(tail)
                yield frame.assign(head=heads, tail=tails)

        marks = sections.repartition("__key", "k").mapInPandas(cut, "__key bigint, k int, n int, t string, head array<bigint>, tail array<bigint>")
        own = Window.partitionBy("__key")
        order = own.orderBy("k")
        # Where a section's piece begins in it, and where the next one begins in the next: both count from a section's start.
        first = lambda a, b: F.array_min(F.array_intersect(a, b))
        spans = marks.select(
            "__key", "k", "n", "t",
            F.when(F.col("k") == 0, 0).otherwise(first(F.lag("tail").over(order), F.col("head"))).alias("a"),
            first(F.col("tail"), F.lead("head").over(order)).alias("b"),
        )
        lost = F.max(F.when(F.col("a").isNull() | (F.col("b").isNull() & (F.col("k") < F.col("n") - 1)), 1).otherwise(0)).over(own)
        spans = spans.withColumn("lost", lost).where("lost = 0 or k = 0")
        # A piece lies within its section, so it is cut from that alone; a text that did not resynchronise is taken whole.
        whole = F.expr(f"if(lost = 1, null, substring(t, cast(a + 1 as int), cast(coalesce(b + {size}, length(t)) - a as int)))")
        cuts = staged(spans.select("__key", "k", whole.alias("t")).repartition("__key", "k"), "bpe-pieces")
        kept_whole = rows.join(cuts.where("t is null").select("__key"), "__key", "left_semi").select("__key", F.lit(0).alias("k"), body.alias("t"))
        coded = _mapped(cuts.where("t is not null").unionByName(kept_whole), "t", {"ids": self._ids()}, ["t"])
        joined = coded.groupBy("__key").agg(F.expr("listagg(ids) WITHIN GROUP (ORDER BY k)").alias("__ids"))
        kept = [F.col("__row").getField(c).alias(c) for c in long.columns if c != to]
        return rows.join(joined, "__key").select(*kept, F.col("__ids").alias(to))

    def decode(self, df: DataFrame, ids: str = "ids", to: str = "decoded") -> DataFrame:
        """df with the column named by ``to``: the tokens' raw bytes put together (null ids: none).
        They need not be UTF-8 when ids are only part of a text's."""
        return _mapped(df, ids, {to: self._raw()})

"""Substring deduplication: windows of 50 words that an earlier document has too are removed.

First pass, a count-min sketch: each window is represented by its minimiser, the least hash among its
25-word parts, so that a dozen neighbouring windows share one update. A partition counts each
minimiser once for a document; the partitions' sketches are merged by adding. A cell holds at least
the number of documents of every minimiser that falls into it, and a minimiser has at least the
documents of each of its windows: a window in two documents is never estimated below two.

Second pass, exact: only windows estimated repeated are emitted, with a 128-bit hash of their words,
and grouped for the smallest id, first among the rows of a task, so that a window in very many
documents is few rows of the shuffle. The sketch grows with the input up to ``MAX_CELLS`` cells a row; beyond
that more windows reach the second pass, and none is lost.

Edge cases: a null text has no words and keeps none. Texts under 50 words have no window. A row
without an id is kept whole and removes nothing from others. Rows of one id are one document to each
other: they remove nothing from one another. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bounded_batches
from .words import Rolling, hash_words, mix, signed

WINDOW = 50
PART = 25
DEPTH = 2
#: Cells in a row of the sketch at most. One bit of each reaches the second pass: 32 MB a row.
MAX_CELLS = 1 << 28
_BLOCK = 32_768


def words(text: str | None) -> list[bytes]:
    """Maximal runs of other characters than ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def minimisers(parts: np.ndarray, window: int, part: int) -> np.ndarray:
    """The least part hash of each window."""
    return sliding_window_view(parts, window - part + 1).min(axis=1)


def _cell(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (row + 1) % (1 << 64))) & np.uint64(cells - 1)).astype(np.int64)


class RepeatSketch:
    """A count-min sketch of the minimisers in documents, of which the second pass needs one bit a
    cell: whether the count is two or more."""

    def __init__(self, docs: DataFrame, window: int, part: int):
        self.window, self.part = window, part
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        self.cells = 1 << 16
        # About one minimiser in 75 characters; sixteen cells for each.
        while self.cells < min(MAX_CELLS, chars // 5):
            self.cells *= 2
        cells, depth = self.cells, DEPTH

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The partition's sketch: its cells that are not zero. Counts above two stay two."""
            rolling, own, pending = Rolling(), [], 0
            for batch in batches:
                for body in batch["text"]:
                    parts = rolling.windows(hash_words(words(body.as_py())), part)
                    if len(parts) > window - part:
                        own.append(np.unique(minimisers(parts, window, part)))
                        pending += len(own[-1])
                    if pending > 2_000_000:
                        yield from sparse(own)
                        own, pending = [], 0
            yield from sparse(own)

        def sparse(own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            every = np.concatenate(own) if own else np.empty(0, np.uint64)
            for row in range(depth):
                cell, n = np.unique(_cell(every, row, cells), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell + row * cells), pa.array(np.minimum(n, 2).astype(np.int8))], names=["cell", "n"])

        merged = docs.select("text").mapInArrow(count, "cell bigint, n tinyint").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
        at = F.col("cell") + 1  # the bitmap functions count from 1
        blocks = merged.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
        self.bits = np.zeros(DEPTH * self.cells // 8, np.uint8)
        for row in blocks.toLocalIterator():
            start = (row["b"] - 1) * _BLOCK // 8
            self.bits[start : start + _BLOCK // 8] = np.frombuffer(bytes(row["m"]), np.uint8)


def repeated(bits: np.ndarray, hashes: np.ndarray, cells: int) -> np.ndarray:
    """Whether each hash is estimated to be in two documents or more."""
    out = np.ones(len(hashes), bool)
    for row in range(DEPTH):
        cell = _cell(hashes, row, cells) + row * cells
        out &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return out


def _reduced(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Windows (a, b, doc_id, place) of some documents, reduced before they are shuffled: of a window's
    documents here the smallest goes on to be compared with those elsewhere. The others have an earlier
    document already, so their rows need no comparison; they have a null b and are spread by document."""
    a, b, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((doc, b, a))
    a, b, doc, place = a[order], b[order], doc[order], place[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = doc > least
    return pa.RecordBatch.from_arrays(
        [pa.array(np.where(later, doc, a)), pa.array(b, mask=later), pa.array(doc), pa.array(place)], names=["a", "b", "doc_id", "place"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by window and document those that come after their window's first document. A stream:
    only the last window and its first document are kept from one batch to the next."""
    last = (None, None)
    for batch in batches:
        if not batch.num_rows:
            continue
        a, doc = batch["a"].to_numpy(), batch["doc_id"].to_numpy()
        settled = batch["b"].is_null().to_numpy(zero_copy_only=False)
        b = batch["b"].fill_null(0).to_numpy()
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (settled[1:] != settled[:-1])
        first = doc[np.flatnonzero(new)]
        if (a[0], b[0], settled[0]) == last[0]:
            first[0] = last[1]
        first = first[np.cumsum(new) - 1]
        last = ((a[-1], b[-1], settled[-1]), first[-1])
        out = settled | (doc > first)
        yield batch.select(["doc_id", "place"]).filter(pa.array(out))


def _removed(frames: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        kept_texts, n_words, n_removed = [], [], []
        for text, at in zip(frame["text"], frame["at"], strict=True):
            own = words(text)
            if at is None or not len(at):
                kept = own
            else:
                edges = np.zeros(len(own) + 1, np.int64)
                at = np.asarray(at, np.int64)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + window, -1)
                kept = [w for w, c in zip(own, np.cumsum(edges).tolist(), strict=False) if not c]
            n_words.append(len(own))
            n_removed.append(len(own) - len(kept))
            kept_texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        yield pd.DataFrame({"n_words": n_words, "n_removed": n_removed, "kept": kept_texts})


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, part: int = PART) -> DataFrame:
    """df with n_words, n_removed and kept (the words that stay, joined by one space) added."""
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.hash(F.col(text)).alias("mark"))
    sketch = RepeatSketch(docs.where("doc_id is not null"), window, part)
    bits, cells = df.sparkSession.sparkContext.broadcast(sketch.bits), sketch.cells
    del sketch

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(), Rolling(second=True)
        held, size = [], 0
        for batch in batches:
            for doc, mark, body in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["text"], strict=True):
                hashes = hash_words(words(body.as_py()))
                parts = one.windows(hashes, part)
                if len(parts) <= window - part:
                    continue
                at = np.flatnonzero(repeated(bits.value, minimisers(parts, window, part), cells))
                if len(at):
                    a, b = signed(one.windows(hashes, window))[at], signed(two.windows(hashes, window))[at]
                    held.append((a, b, np.full(len(at), doc), at + (mark << 32)))
                    size += len(at)
                if size >= 500_000:
                    yield _reduced(held)
                    held, size = [], 0
        if held:
            yield _reduced(held)

    found = docs.where("doc_id is not null and text is not null").mapInArrow(emit, "a bigint, b bigint, doc_id bigint, place bigint")
    covered = found.repartition("a", "b").sortWithinPartitions("a", "b", "doc_id").mapInArrow(_later, "doc_id bigint, place bigint")
    marks = covered.select(
        F.col("doc_id").alias("__doc"), F.shiftright("place", 32).cast("int").alias("__mark"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at"))
    marks = marks.groupBy("__doc", "__mark").agg(F.collect_list("at").alias("__at"))
    rows = df.join(marks, (F.col(doc_id) == F.col("__doc")) & (F.hash(F.col(text)) == F.col("__mark")), "left")

    @F.pandas_udf("n_words bigint, n_removed bigint, kept string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from _removed((pd.DataFrame({"text": t, "at": a}) for t, a in batches), window)

    done = rows.withColumn("__cut", cut.asNondeterministic()(F.col(text), F.col("__at")))
    fields = {c: F.col(f"__cut.{c}") for c in ("n_words", "n_removed", "kept")}
    return done.withColumns(fields).drop("__doc", "__mark", "__at", "__cut")

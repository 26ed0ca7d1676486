"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Seeds are three words of an item in their order, with one word at most skipped among them, on the item's
side and on the document's, so that a changed, dropped or added word breaks few of them. A Bloom
filter of bounded size holds their hashes; documents emit the passages in which n-grams pass it, with those
n-grams. Every seed joins passages to items, however many passages hold it. Few seeds are broadcast; more
are joined by shuffling, each salted, so that a frequent one is spread over many tasks. Each joined passage
is cut to where the item could lie; one that holds too few of the item's words to reach the threshold is
dropped, the others are aligned with the item, word by word, local alignment: match 2, other word -1,
gap -1. The score is the best alignment's sum over that of the item with itself, so 1 for a whole copy, and
less as words are changed, dropped or put in.

A pair is missed only if it has no three matched words with one word at most among them, on either side. The
tests hold the result against the alignment of every pair, with words changed, dropped and added at rates up to
a third.

Edge cases: null or wordless texts and items match nothing, nor does an empty table. Items shorter than a
seed are one seed themselves, and have to be there whole. Texts of any length are read whole. Of equal scores
the passage that begins first is reported. Repeated rows are one row of the result for an id; a null id is
reported like any other. An item without an id counts, as one for each text. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import text_mark
from .staging import bounded_batches, staged
from .words import hash_words, signed

_WORD = re.compile(r"\w+")
SEED = 3
#: Bits of the Bloom filter at most; 32 MB, whatever the number of test items.
MAX_BITS = 1 << 28
#: Up to so many seeds of items are broadcast; more are joined by shuffling, in so many parts a seed.
BROADCAST_ROWS = 200_000
SALTS = 16
#: Up to so many names of rows to drop are broadcast.
BROADCAST_LEAKS = 200_000
_BLOCK = 32_768
_PROBES = 4


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _hashes(tokens: list[str]) -> np.ndarray:
    return hash_words([w.encode("utf-8", "replace") for w in tokens])


#: Places of a seed's second and third word after its first; in the first pattern none is skipped.
_PATTERNS = ((1, 2), (1, 3), (2, 3))
_FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def seeds_of(hashes: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, int, bool]]:
    """For each pattern: the seeds of n words at all places, how far their last word is from the first, and whether
    none is skipped. Fewer words than three skip none."""
    terms = [hashes * factor for factor in _FACTORS[:n]]
    for pattern in [tuple(range(1, n))] if n < SEED else _PATTERNS:
        last = pattern[-1] if pattern else 0
        count = max(0, len(hashes) - last)
        seeds = terms[0][:count] + np.uint64(n)
        for at, term in zip(pattern, terms[1:], strict=True):
            seeds = seeds + term[at : at + count]
        yield seeds, last, pattern == tuple(range(1, n))


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
            tokens = words(text)
            if tokens:
                n = min(SEED, len(tokens))
                found = list(seeds_of(_hashes(tokens), n))
                seeds = np.concatenate([x for x, _, _ in found])
                at = np.concatenate([np.arange(len(x), dtype=np.int32) for x, _, _ in found])
                plain = np.concatenate([np.full(len(x), run) for x, _, run in found])
                size = len(seeds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * size, pa.int64()), pa.array(signed(seeds)), pa.array(at), pa.array(plain),
                     pa.array([n] * size, pa.int32()), pa.array([len(tokens)] * size, pa.int32())],
                    names=["item", "seed", "at", "plain", "n", "length"])


class SeedFilter:
    """A Bloom filter of seeds in 4 KB blocks, built by Spark; only its blocks come to the driver."""

    def __init__(self, seeds: DataFrame, count: int):
        self.bits = 1 << 16
        while self.bits < min(MAX_BITS, 64 * count):
            self.bits *= 2
        cell = F.explode(F.array(*(self._probe(F.col("seed"), k) for k in range(_PROBES))))
        cells = seeds.select("seed").distinct().select(cell.alias("c"))
        blocks = cells.groupBy(F.bitmap_bucket_number("c").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("m"))
        self.table = np.zeros(self.bits // 8, np.uint8)
        for row in blocks.toLocalIterator():
            at = (row["b"] - 1) * _BLOCK // 8
            self.table[at : at + _BLOCK // 8] = np.frombuffer(bytes(row["m"]), np.uint8)[: len(self.table) - at]

    def _probe(self, seed, k: int):
        # Seeds are sums of mixed hashes, so four ranges of their bits, which overlap little, serve as probes. The bitmap functions count from 1.
        return F.shiftrightunsigned(seed, 12 * k).bitwiseAND(F.lit(self.bits - 1)) + 1

    def passes(self, seeds: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The positions of seeds that may be in the filter."""
        found = np.arange(len(seeds))
        for k in range(_PROBES):
            cell = ((seeds[found] >> np.uint64(12 * k)) & np.uint64(self.bits - 1)).astype(np.int64)
            found = found[(table[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1]
        return found


def align(passages: list[list[int]], items: list[list[int]]) -> np.ndarray:
    """Best local alignment of each passage with its item, over the item's own; all pairs at once.
    Row by row over the item's words; gaps along the passage are a running maximum."""
    rows, width = max(map(len, items), default=0), max(map(len, passages), default=0)
    if not rows or not width:
        return np.zeros(len(items))
    p = np.full((len(items), width), -1, np.int64)
    q = np.full((len(items), rows), -2, np.int64)
    for i, (a, b) in enumerate(zip(passages, items, strict=True)):
        p[i, : len(a)], q[i, : len(b)] = a, b
    slope = np.arange(width, dtype=np.int32)
    h, best = np.zeros((len(items), width + 1), np.int32), np.zeros(len(items), np.int32)
    for j in range(rows):
        here = np.maximum(h[:, :-1] + np.where(p == q[:, j : j + 1], 2, -1).astype(np.int32), h[:, 1:] - 1)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        h[:, 1:] = here
        np.maximum(best, here.max(axis=1), out=best)
    return best / np.array([2 * max(1, len(b)) for b in items])


def _scores(threshold: float):
    def scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            a = [words(t) for t in frame["passage"]]
            b = [words(t) for t in frame["test"]]
            # A score is at most the share of the item's words that the passage holds.
            near = np.array([len(y) * threshold <= sum(map(set(x).__contains__, y)) + 1e-6 * len(y) for x, y in zip(a, b, strict=True)], bool)
            frame, a, b = frame[near], [x for x, k in zip(a, near, strict=True) if k], [y for y, k in zip(b, near, strict=True) if k]
            out = np.zeros(len(frame))
            order = np.argsort([len(x) * 100_000 + len(y) for x, y in zip(a, b, strict=True)], kind="stable")
            at = 0
            while at < len(order):  # pairs of like size together, about a million cells at a time
                n = max(1, min(256, 1_000_000 // max(1, len(a[order[min(len(order) - 1, at + 255)]]))))
                part, ids = order[at : at + n], {}
                code = lambda ws: [ids.setdefault(w, len(ids)) for w in ws]  # noqa: B023, E731
                out[part] = align([code(a[i]) for i in part], [code(b[i]) for i in part])
                at += n
            yield frame[["doc_id", "mark", "item_id", "begin", "seeds"]].assign(score=np.round(out, 6))

    return scores


def _leaks(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, mark, item_id, begin, seeds, score): aligned passages whose score reaches the threshold."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shape = "doc_id bigint, mark bigint, item_id bigint, begin int, seeds bigint, score double"
    items = bench.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item).alias("text")).where("text is not null").distinct()
    items = staged(items.withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "text")), "leak-items")
    seeds = staged(items.select("item", "text").mapInArrow(_item_seeds, "item bigint, seed bigint, at int, plain boolean, n int, length int"), "leak-seeds")
    count, longest, sizes = seeds.agg(F.count(F.lit(1)), F.max("length"), F.collect_set("n")).first()
    if not count:
        return spark.createDataFrame([], shape)
    bloom = SeedFilter(seeds, count)
    table, sizes = spark.sparkContext.broadcast(bloom.table), sorted(sizes)
    bloom.table = None

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            out: list[tuple] = []
            docs = [words(body.as_py()) for body in batch["text"]]
            # All texts of a batch at once; a seed lies within one text.
            hashes = _hashes([w for tokens in docs for w in tokens])
            owner = np.repeat(np.arange(len(docs)), [len(tokens) for tokens in docs])
            start = np.concatenate(([0], np.cumsum([len(tokens) for tokens in docs]))).astype(np.int64)
            found: dict[int, list] = {}
            for n in sizes:
                for grams, last, plain in seeds_of(hashes, n):
                    hit = bloom.passes(grams, bits)
                    hit = hit[owner[hit] == owner[hit + last]]
                    for doc, at, seed in zip(owner[hit].tolist(), (hit - start[owner[hit]]).tolist(), signed(grams[hit]).tolist(), strict=True):
                        found.setdefault(doc, []).append((at, seed, plain))
            for doc, hits in found.items():
                tokens, name = docs[doc], (batch["doc_id"][doc].as_py(), batch["mark"][doc].as_py())
                hits.sort()
                first = 0
                for i in range(1, len(hits) + 1):  # hits further apart than any item are passages of their own
                    if i == len(hits) or hits[i][0] - hits[i - 1][0] > longest:
                        own = hits[first:i]
                        lo, hi = max(0, own[0][0] - longest), own[-1][0] + longest
                        out.append((*name, lo, " ".join(tokens[lo:hi]), *([x[k] for x in own] for k in (1, 0, 2))))
                        first = i
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["doc_id", "mark", "start", "passage", "seed", "pos", "run"])

    found = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_mark(text).alias("mark"), F.col(text).alias("text")).mapInArrow(
        passages, "doc_id bigint, mark bigint, start int, passage string, seed array<bigint>, pos array<int>, run array<boolean>")
    found = staged(found.withColumn("key", F.xxhash64("doc_id", "mark", "start", "passage")), "leak-passages")
    hits = found.select("key", F.inline(F.arrays_zip("seed", "pos", "run")))
    wanted = seeds.select("seed", "item", "at", "plain", "length")
    if count <= BROADCAST_ROWS:
        pairs = hits.join(F.broadcast(wanted), "seed")
    else:
        wanted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = hits.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(wanted, ["seed", "salt"])
    pairs = pairs.groupBy("key", "item").agg(
        F.min(F.col("pos") - F.col("at")).alias("lo"), F.max(F.col("pos") - F.col("at") + F.col("length")).alias("hi"),
        F.max("length").alias("length"), F.countDistinct(F.when(F.col("run") & F.col("plain"), F.col("seed"))).alias("seeds"))
    placed = pairs.join(found.select("key", "doc_id", "mark", "start", "passage"), "key")
    begin = F.greatest(F.col("lo") - F.ceil(F.col("length") / 2).cast("int"), F.col("start"))
    # lo and hi are words of the document; the margin leaves room for words put in before or after.
    placed = placed.withColumn("begin", begin.cast("int")).withColumn(
        "passage", F.expr("array_join(slice(split(passage, ' '), begin - start + 1, hi - begin + cast(ceil(length / 2) as int)), ' ')"))
    aligned = placed.select("doc_id", "mark", "item", "begin", "seeds", "passage").join(items.withColumnRenamed("text", "test"), "item")
    return aligned.drop("item").mapInPandas(_scores(threshold), shape).where(F.col("score") >= threshold)


def contaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, score, seeds, begin): pairs whose score reaches the threshold. begin is the word of the
    document at which the aligned passage starts, seeds the number of shared seeds without a skipped word."""
    best = F.max_by(F.struct("seeds", "begin"), F.struct("score", -F.col("begin"))).alias("b")
    found = _leaks(docs, bench, **options).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), best)
    return found.select("doc_id", "item_id", "score", "b.seeds", "b.begin")


def without_leaks(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """docs without the contaminated rows, all columns. A row is named by its id and its text's hash, so that
    clean texts stay under an id, or a null, that a contaminated one has too."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    leaks = staged(_leaks(docs, bench, **options).select(F.col("doc_id").alias("__leak"), F.col("mark").alias("__marked")).distinct(), "leaks")
    if leaks.limit(BROADCAST_LEAKS + 1).count() <= BROADCAST_LEAKS:
        leaks = F.broadcast(leaks)  # else the texts are shuffled by their names
    named = F.col(doc_id).cast("bigint").eqNullSafe(F.col("__leak")) & (F.col("__mark") == F.col("__marked"))
    return docs.withColumn("__mark", text_mark(text)).join(leaks, named, "left_anti").select(*docs.columns)

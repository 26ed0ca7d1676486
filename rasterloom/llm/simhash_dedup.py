"""Near-duplicates by SimHash fingerprints and deletion-variant signatures.

Fingerprints (64 bits, over word shingles) are linked when they differ in at most four bits. Cut into
three segments, two such fingerprints have a segment in which they differ in one bit at most; so each
segment is indexed once for every bit of it, with that bit left out, and linked fingerprints meet in
one of those 64 buckets. An equality join on the buckets finds candidates, an XOR verifies them.

Equal fingerprints are one entry. A bucket of two or three entries is verified as it is counted. In a
larger one not all pairs are made:

1. Each entry is verified against four pivots of its bucket, the smallest, the largest and two by hash,
   which joins dense groups into few components.
2. Outsiders are the entries outside their bucket's most frequent component. The fingerprints of buckets that have
   some get a second index: 31 covering masks of about 33 bits (Pagh, Locality-sensitive Hashing without False Negatives,
   2016), under one of which any two linked ones agree. Of unrelated ones at t differing bits about one pair in
   2^t / 31 agrees. Under each key again only outsiders are compared, with members of other components.

No link between different components is lost, and a link within one has nothing left to join.

Edge cases: a text that is null or has no word has fingerprint 0, which is linked like any other.
Null ids take part, but a component's id is null only if all its ids are. Repeated rows share a
component. An empty table has an empty result. Texts of any length are read whole, in blocks of
shingles. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .rows import picked, text_mark
from .staging import bounded_batches, staged

#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4
#: Up to so many buckets of four entries or more are broadcast to the entries.
BROADCAST_ROWS = 500_000
#: Fingerprints of a task before it makes its rows of each: 64 buckets, or 31 masks.
TASK_PRINTS = 1 << 14


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, last, 65_536):
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(at, min(last, at + 65_536))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def _fingerprints(text: Column) -> Column:
    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64))

    return of(text)


def _spread(prints: DataFrame) -> DataFrame:
    """prints over a task for each TASK_PRINTS of them. A file of a few bytes a row would be one task, whose aggregate
    holds 64 rows for each."""
    return prints.repartition(max(1, math.ceil(prints.count() / TASK_PRINTS)), "fp")


def _buckets(prints: DataFrame) -> DataFrame:
    """(bucket, fp): 64 rows for each fingerprint. A bucket is the bit left out and the segment's rest."""
    keys = []
    for start, width in SEGMENTS:
        for bit in range(width):
            mask = ((1 << width) - 1) & ~(1 << bit)
            part = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit(mask))
            keys.append((part + F.lit((start + bit) << 22)).cast("int"))
    return prints.select("fp", F.explode(F.array(*keys)).alias("bucket"))


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


_MID = "CASE WHEN n = 3 THEN `all` ^ lo ^ hi END"
_SOME_NEAR = " or ".join(f"bit_count({a} ^ {b}) <= {MAX_BITS}" for a, b in (("lo", "hi"), ("lo", f"({_MID})"), (f"({_MID})", "hi")))


def _followed(roots: DataFrame, over: DataFrame) -> DataFrame:
    """(node, root) of roots, whose roots have roots of their own in over, which may have further nodes."""
    on = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return on.select("node", F.coalesce("top", "root").alias("root")).unionByName(over.join(roots, "node", "left_anti"))


def _outsiders(members: DataFrame) -> DataFrame:
    """Members (bucket, fp, part) that are not of their bucket's largest part, with top, that part."""
    parts = members.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1")
    mixed = mixed.select(F.col("bucket").alias("of"), F.col("top.part").alias("top"))
    return members.join(mixed, (F.col("bucket") == F.col("of")) & (F.col("part") != F.col("top"))).drop("of")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = MAX_BITS) -> list[int]:
    """Masks of about 33 bits, under one of which any two fingerprints agree that differ in at most radius bits.

    Each bit has a vector of radius + 1 bits, not zero; mask v keeps the bits whose vector has an odd product with v. The
    vectors of radius bits leave a v with which all their products are even, so that v keeps none of these bits."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if ((i % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _keyed(prints: DataFrame) -> DataFrame:
    """(bucket, v, fp, part): a row for each covering mask v of each fingerprint; bucket stands for v and the bits it keeps."""
    keys = [F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("kept")) for v, m in enumerate(covering_masks())]
    return prints.select("fp", "part", F.explode(F.array(*keys)).alias("k")).select(F.xxhash64("k.v", "k.kept").alias("bucket"), F.col("k.v").alias("v"), "fp", "part")


def _met(outsiders: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints of different parts, and v, that meet under a mask and are to be compared."""
    a, b = outsiders.alias("a"), members.alias("b")
    once = F.expr("a.bucket = b.bucket and a.v = b.v and a.part <> b.part and (b.part = a.top or a.fp < b.fp)")
    return a.join(b, once).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"), F.col("a.part").alias("u"), F.col("b.part").alias("w"), "a.v")


def _cross_links(parts: DataFrame, mixed: DataFrame) -> DataFrame:
    """(u, v): parts that are linked by fingerprints in the mixed buckets, those with members of several parts."""
    prints = staged(parts.join(mixed, "bucket", "left_semi").groupBy("fp").agg(F.first("part").alias("part")), "simhash-inside")
    keyed = staged(_keyed(_spread(prints)), "simhash-keyed")
    pairs = _met(_outsiders(keyed), keyed).where(_near("a", "b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(None).cast("int")
    for v, m in reversed(list(enumerate(covering_masks()))):
        first = F.when(x.bitwiseAND(F.lit(_signed(m))) == 0, v).otherwise(first)
    return pairs.where(first == F.col("v")).select("u", F.col("w").alias("v")).distinct()


def _links(prints: DataFrame) -> DataFrame:
    """(node, root): fingerprints that have a link, with the smallest one they reach."""
    entries = _buckets(_spread(prints))
    by_hash = lambda pick, seed: pick("fp", F.xxhash64("fp", F.lit(seed)))
    ends = entries.groupBy("bucket").agg(
        F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_xor("fp").alias("all"), F.count(F.lit(1)).alias("n"),
        by_hash(F.min_by, 1).alias("p"), by_hash(F.max_by, 1).alias("q")).where("n > 1")
    # Two or three entries are known from the aggregate: the third is what the others leave of the XOR.
    few = staged(ends.where("n > 3 or " + _SOME_NEAR).withColumn("mid", F.expr(_MID)), "simhash-ends")
    pairs = F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (("lo", "hi"), ("lo", "mid"), ("mid", "hi"))))
    known = few.where("n <= 3").select(F.explode(pairs).alias("p")).select("p.u", "p.v").where(_near("u", "v"))
    pivots = ("lo", "hi", "p", "q")
    large = few.where("n > 3").select("bucket", *pivots)
    if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        large = F.broadcast(large)  # else the entries are shuffled once more
    members = staged(entries.join(large, "bucket"), "simhash-members")
    star = reduce(DataFrame.unionByName, (members.select(F.col("fp").alias("u"), F.col(p).alias("v")).where(_near("u", "v")) for p in pivots), known)
    roots = staged(components(star, "simhash-star"), "simhash-stars")
    joined = members.select("bucket", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    parts = staged(joined.select("bucket", "fp", F.coalesce("root", "fp").alias("part")), "simhash-parts")
    mixed = staged(_outsiders(parts).select("bucket").distinct(), "simhash-mixed")
    if mixed.isEmpty():
        return roots
    return _followed(roots, components(_cross_links(parts, mixed), "simhash-cross"))


def _named(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, fp), and (fp, root, component_id) of each fingerprint."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(doc_id).alias("doc_id"), text_mark(text).alias("mark"), _fingerprints(F.col(text)).alias("fp"))
    rows = staged(rows, "simhash-prints")
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    rooted = prints.join(staged(_links(prints), "simhash-links").withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rows, rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, fp (bigint), component_id (the smallest doc_id reachable)."""
    rows, named = _named(df, doc_id, text)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def without_near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each component, all columns: that of the smallest id, or one without an id where no
    row has one. An id shared by texts of several components stands for a row of each. Of texts with the
    smallest id the one with the smallest hash stays."""
    rows, named = _named(df, doc_id, text)
    names = rows.groupBy("doc_id", "mark", "fp").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("key"), "mark", "n")).alias("x")
    chosen = staged(names.join(named, "fp").groupBy("root").agg(first).select("x.key", "x.mark", "x.n"), "simhash-chosen")
    return picked(df, chosen, text_mark(text), F.coalesce(F.col(text), F.lit("")), doc_id, text)

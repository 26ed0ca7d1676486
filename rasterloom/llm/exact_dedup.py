"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Rows' digests are read in batches, the memtables. Each flushes a run, (digest, smallest identifier, count)
sorted by digest in each file. When a level has ``fanout`` runs, compaction merges them into one run of the
next level; of each digest the smallest identifier and the sum of counts stay. The last run's filter holds the
digests that occur more than once, as a Bloom filter in blocks of bounded size; a scan of the texts probes it,
so that only hits are shuffled. Hits are verified byte for byte, by grouping their normalised texts
themselves, so that two texts with one digest never count as copies.

Edge cases: a null text counts as empty. Null ids sort last: such a row is kept only if no id of its
group is known, and its keep_id is then null. Repeated rows are copies of each other. Texts of any length
are compared whole. An empty table has an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import picked
from .staging import staged

#: Batches of the input; runs of a level that are merged.
MEMTABLES, FANOUT = 4, 2
#: Blocks of a filter at most, of 64 words of 64 bits: 32 MB. With more digests than a sixteenth of its bits
#: more rows that are no hits pass; they are verified like hits, and results stay the same.
MAX_BLOCKS = 1 << 16
_PROBES = 3


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes the empty string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class RunFilter:
    """A Bloom filter of digests: a table (block, words) that is broadcast, as its size is bounded."""

    def __init__(self, digests: DataFrame):
        self.blocks = 1
        count = digests.count()
        while self.blocks < min(MAX_BLOCKS, count / 256):
            self.blocks *= 2
        probe = F.explode(F.array(*(F.struct(self._word(k).alias("word"), self._bit(k).alias("bit")) for k in range(_PROBES)))).alias("p")
        words = digests.select(self._block().alias("block"), probe).groupBy("block", "p.word").agg(F.bit_or(F.expr("shiftleft(1L, p.bit)")).alias("bits"))
        by_word = F.map_from_entries(F.collect_list(F.struct("word", "bits")))  # 64 words at most
        self.table = words.groupBy("block").agg(by_word.alias("words"))

    def _block(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.blocks)).cast("int")

    def _word(self, k: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64("digest", F.lit(1)), 12 * k).bitwiseAND(F.lit(63)).cast("int")

    def _bit(self, k: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64("digest", F.lit(1)), 12 * k + 6).bitwiseAND(F.lit(63)).cast("int")

    def hits(self, rows: DataFrame) -> DataFrame:
        """The rows whose digest is in the filter, and few others."""
        table = F.broadcast(self.table.select(F.col("block").alias("__block"), F.col("words").alias("__words")))
        found = rows.join(table, self._block() == F.col("__block"))
        for k in range(_PROBES):
            found = found.where(F.getbit(F.coalesce(F.try_element_at("__words", self._word(k)), F.lit(0).cast("bigint")), self._bit(k)) == 1)
        return found.select(*rows.columns)


class MergeIndex:
    """digest -> (smallest id, count), in levels of runs (digest, keep_id, n)."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def flush(self, rows: DataFrame) -> None:
        """Adds a memtable's rows (doc_id, digest) as a run, and merges levels that are full."""
        run = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        self._add(run, 0)

    def _add(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(staged(run.sortWithinPartitions("digest"), f"lsm-run{level}"))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._add(self._merged(runs), level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        every = runs[0]
        for run in runs[1:]:
            every = every.unionByName(run)
        return every.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def compact(self) -> DataFrame:
        """Merges what is left on all levels into one run and returns it."""
        runs = [run for level in self.levels for run in level]
        if len(runs) > 1:
            self.levels = [[staged(self._merged(runs).sortWithinPartitions("digest"), "lsm-run")]]
        else:
            self.levels = [runs]
        return self.levels[0][0]


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256, memtables: int = MEMTABLES) -> DataFrame:
    """One row for each row of df: doc_id, digest, keep_id, group_size, kept.

    ``digest`` may be weaker than the default; results stay the same, only more rows are hits.
    """
    named = df.select(F.col(doc_id).alias("doc_id"), digest(normalised(F.col(text))).alias("digest"))
    rows = staged(named.withColumn("memtable", F.pmod(F.spark_partition_id(), F.lit(memtables))), "lsm-rows")
    index = MergeIndex()
    for k in range(memtables):
        index.flush(rows.where(F.col("memtable") == k))
    rows, level = rows.drop("memtable"), index.compact()
    texts = df.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("text")).withColumn("digest", digest(F.col("text")))
    suspects = RunFilter(level.where("n > 1").select("digest")).hits(texts)
    copies = [F.min("doc_id").alias("v_keep"), F.count(F.lit(1)).alias("v_n")]
    verified = staged(suspects.groupBy("digest", "text").agg(*copies).drop("text"), "lsm-verified")
    sizes = verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("v_keep").alias("v_keep"), F.min("v_n").alias("v_n"))
    clash = sizes.where("texts > 1").select("digest")
    alone = F.col("v_n").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("v_keep"))
    shape = lambda rows: rows.select(
        "doc_id", "digest", keep.alias("keep_id"), F.when(alone, 1).otherwise(F.col("v_n")).cast("bigint").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"))
    simple = rows.join(sizes.where("texts = 1").drop("texts"), "digest", "left")
    if clash.isEmpty():
        return shape(simple)
    # Where one digest stands for several texts, rows find their group by the text itself.
    clashing = suspects.join(clash, "digest", "left_semi")
    by_text = clashing.groupBy("digest", "text").agg(*copies)
    return shape(simple.join(clash, "digest", "left_anti")).unionByName(shape(clashing.join(by_text, ["digest", "text"])))


def without_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of equal texts, all columns: a row of the smallest id. Rows of one id with
    different texts are different rows, and so are rows without an id; rows that repeat are one."""
    groups = staged(exact_groups(df, doc_id, text), "lsm-groups")
    chosen = groups.where("kept").groupBy(F.col("doc_id").alias("key"), F.col("digest").alias("mark")).agg(F.count(F.lit(1)).alias("n"))
    return picked(df, chosen, sha256(normalised(F.col(text))), normalised(F.col(text)), doc_id, text)

"""The corpus pipeline: language ID, exact and near deduplication, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the
shared folder and gives it, read again, to the next. All but the last keep the columns of documents, further
ones too, whatever their names.

Rows may share an id or have none: each stage decides on rows by id and text, so no text is lost under another
one's id. Null and empty texts have no language and go in the first stage; the later ones take them as empty.
Rows that repeat become one in the second stage. Texts of any length are read whole. An empty table, of
documents or of test items, goes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.decontaminate import without_leaks
from rasterloom.llm.exact_dedup import without_copies
from rasterloom.llm.language_id import UNKNOWN, LanguageProfiles, held_out
from rasterloom.llm.queries import public_bpe
from rasterloom.llm.simhash_dedup import without_near_copies
from rasterloom.llm.staging import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no identifiable language: those whose text is null or has no letter, and all of them where
    no document is labelled."""
    model = LanguageProfiles().fit(docs.where(~held_out()))
    return model.predict(docs, to="__lang", score="__cosine").where(F.col("__lang") != UNKNOWN).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, that of the smallest id; ids sort before no id."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints, that of the smallest id; ids sort before no id."""
    return without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a benchmark item, edited or not; items with no id count too."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with a check that decoding them gives the text back."""
    coded = public_bpe().round_trip(docs)
    return coded.select(
        "doc_id", "lang", "source", "n_chars",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids",
        (F.coalesce("text", F.lit("")).cast("binary") == F.col("decoded")).alias("round_trip"),
    )


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: No SQL has the learned language profiles, SimHash's XXH64 or the byte-level merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Picking whole rows by a decision about them, where ids may be shared or missing.

A row is named by its id and a mark made from its text, so that rows of one id with different texts,
and rows without an id, are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType


def text_mark(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def picked(df: DataFrame, chosen: DataFrame, mark: Column, same: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df named by chosen (key, mark, n), all columns; n is how many rows have the name. Of
    several with one id and equal ``same`` one stays: the one whose text, then whose row, sorts first."""
    names = chosen.select(F.col("key").alias("__key"), F.col("mark").alias("__pick"), F.col("n").alias("__n"))
    rows = df.withColumn("__mark", mark)
    rows = rows.join(names, F.col(doc_id).eqNullSafe(F.col("__key")) & (F.col("__mark") == F.col("__pick")))
    once = rows.where("__n = 1").select(*df.columns)
    if chosen.where("n > 1").isEmpty():
        return once
    plain = [f.name for f in df.schema if not isinstance(f.dataType, MapType | VariantType)]
    least = F.min_by(F.struct(*df.columns), F.struct(F.col(text), F.xxhash64(*plain))).alias("__row")
    many = rows.where("__n > 1").groupBy(F.col(doc_id).alias("__a"), F.col("__mark").alias("__b"), same.alias("__c")).agg(least)
    return once.unionByName(many.select("__row.*"))

"""Vocabularies as tables of the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_products(rows: DataFrame, vocabulary: DataFrame, product: str = "product", other: str = "Other") -> DataFrame:
    """B12 by a table: rows with base, label and rank of their product from vocabulary (base, label, rank).

    The base is the longest one of the table that the product is or continues with
    an underscore; the rest stands in brackets behind its label. A product without
    one, or null, has the base 'other'. Each distinct product is looked up once, by
    an equi join on what it begins with, so neither side has to be small; of rows
    of the table with one base the smallest counts.
    """
    own = F.lower(F.coalesce(F.col(product), F.lit("")))
    seen = rows.select(own.alias("__p")).distinct()
    words = F.split("__p", "_")
    begins = seen.select("__p", F.explode(F.sequence(F.lit(1), F.size(words))).alias("__n")).withColumn("base", F.array_join(F.slice(F.split("__p", "_"), 1, F.col("__n")), "_"))
    table = vocabulary.groupBy(F.lower("base").alias("base")).agg(F.min(F.struct("rank", "label")).alias("__v"))
    found = begins.join(table, "base").groupBy("__p").agg(F.max_by(F.struct("base", "__v"), "__n").alias("__b"))
    variant = F.replace(F.substr("__p", F.length("__b.base") + 2), F.lit("_"), F.lit(" "))
    label = F.when(F.col("__p") == F.col("__b.base"), F.col("__b.__v.label")).otherwise(F.concat(F.col("__b.__v.label"), F.lit(" ("), variant, F.lit(")")))
    told = seen.join(found, "__p", "left").select(
        "__p", F.coalesce("__b.base", F.lit("other")).alias("base"), F.coalesce(label, F.lit(other)).alias("label"), F.col("__b.__v.rank").alias("rank"))
    return rows.withColumn("__p", own).join(told, "__p").drop("__p")

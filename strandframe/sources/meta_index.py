"""An index of metadata for selections: entries (name, number, text, value, sample_id) in Parquet, sorted by name, number and text.

An attribute has an entry for each name that finds it: itself, and what stands behind each of its dots. So a condition that
a suffix match would have to look for in every row is an equality on name here, and Spark skips the files and row groups whose
statistics exclude it: a selection reads the ranges of its own names and numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metadata import Predicate, as_number


def names(attribute: Column) -> Column:
    """The attribute and each of its dotted endings."""
    parts = F.split(attribute, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def build(meta: DataFrame, folder: str) -> None:
    """Writes the index below folder: entries, and samples, the ids of all samples with metadata.

    Entries are dealt by range of all sorted columns, so a name that every sample has is several tasks and files.
    """
    entries = meta.select(F.explode(names(F.col("attribute"))).alias("name"), as_number(F.col("value")).alias("number"), F.lower("value").alias("text"), "value", "sample_id").distinct()
    line = ["name", "number", "text", "sample_id"]
    entries.repartitionByRange(*line).sortWithinPartitions(*line).write.parquet(f"{folder}/entries")
    meta.select("sample_id").distinct().write.parquet(f"{folder}/samples")


def samples_where(spark: SparkSession, folder: str, predicate: Predicate) -> DataFrame:
    """The ids of the samples that satisfy the predicate, as metadata.samples_where finds them."""
    flags = [f"_p{i}" for i in range(len(predicate.leaves))]
    wanted = reduce(lambda a, b: a | b, predicate.entries)
    hits = spark.read.parquet(f"{folder}/entries").where(F.col("name").isin(*set(predicate.names)) & wanted)
    met = hits.groupBy("sample_id").agg(*(F.count_if(e).alias(n) for e, n in zip(predicate.entries, flags, strict=True)))
    everyone = spark.read.parquet(f"{folder}/samples")
    known = everyone.join(met, "sample_id", "left").fillna(0, flags)
    return known.where(predicate.holds([F.col(n) > 0 for n in flags])).select("sample_id")

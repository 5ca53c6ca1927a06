"""Helpers that the corpus operators share, beside those of the library's storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import HOT_KEYS, dimension_join, hot_keys, kept, salted_join, skewed_join, spread_join, work_folder

__all__ = ["HOT_KEYS", "WORD", "dimension_join", "documents", "free_names", "hot_keys", "kept", "ranked", "salted_join", "skewed_join", "spread_join", "work_folder"]

#: A word: what stands between white space, that is space and 0x09 to 0x0D.
WORD = r"[^ \t-\r]+"


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as keep them from being columns."""
    taken = {c.lower() for c in columns}
    while any(n.lower() in taken for n in names):
        names = tuple(f"_{n}" for n in names)
    return list(names)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add `name`, 0 for the first row in `order`, without a window over all rows: rows are dealt by
    range, counted in each part, and only the counts of the parts meet on the driver."""
    spark = df.sparkSession
    parts = kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    before, so_far = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        before.append((part, so_far))
        so_far += n
    offsets = spark.createDataFrame(before, "_part int, _before long")
    row = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_row", row.cast("long")).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")

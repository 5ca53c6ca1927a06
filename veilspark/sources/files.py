"""Listings of input files, with content only where it is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGETS, OLD = r"(?i)\.(docx|xlsx|xlsm)$", r"(?i)\.(doc|xls)$"


def is_target(name: Column, with_pdf: bool = False) -> Column:
    return name.rlike(TARGETS) | (F.lit(with_pdf) & name.rlike(r"(?i)\.pdf$"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, modified, bytes and content of the files below folder, without lock, hidden and partial
    ones. Reading no content costs no read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    rows = files.select("path", name.alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")
    return rows.filter(~F.col("name").rlike(r"^(?:~\$|\.)|\.part$"))


def targets(spark: SparkSession, folder: str, with_pdf: bool = False) -> tuple[DataFrame, DataFrame]:
    """Files to mask, and old formats that are reported instead."""
    files = listing(spark, folder)
    return files.filter(is_target(F.col("name"), with_pdf)), files.filter(F.col("name").rlike(OLD)).select("path", "name")


def hashed(files: DataFrame) -> DataFrame:
    return files.select("path", "name", F.col("bytes").alias("size"), F.sha2("content", 256).alias("hash"))


def document_kind(name: Column, sheets: Column) -> Column:
    """Kind of document from its name and the names of its sheets (one text)."""
    both = F.concat_ws(" ", name, sheets)
    kinds = (("支援経過", "支援経過"), ("計画書", "計画書"), ("第1表", "計画書"), ("フェイスシート", "フェイスシート"), ("アセスメント", "アセスメント"))
    out = F.lit("その他")
    for word, kind in reversed(kinds):
        out = F.when(both.contains(word), kind).otherwise(out)
    return out

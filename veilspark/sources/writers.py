"""Sinks: append-only tables, reports and new files that replace nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tsv_escape


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append ledger rows as tab-separated text: M with status, stage and report, S and R with their ref."""
    fields = F.when(F.col("kind") == "M", F.concat_ws("\t", "kind", "at", "h1", "status", "h2", "ref")).otherwise(F.concat_ws("\t", "kind", "at", "h1", "ref"))
    rows.select(*[tsv_escape(F.col(c).cast("string")).alias(c) for c in ("kind", "at", "h1", "status", "h2", "ref")]).select(fields.alias("value")).write.mode("append").text(path)


def scrubbed(message: Column) -> Column:
    """A log message that shows shapes instead of what was in quotes or brackets, and no digits."""
    return F.regexp_replace(F.regexp_replace(message, "「[^」]*」|\"[^\"]*\"|【[^【】]*】", "「…」"), "[0-9０-９]", "9")


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows (at, screen, message), scrubbed."""
    rows.select(F.concat_ws("\t", F.col("at").cast("string"), "screen", scrubbed(F.col("message"))).alias("value")).write.mode("append").text(path)


def mask_report(status: DataFrame, counts: DataFrame, most: int = 80) -> DataFrame:
    """Lines of a report: for each document its status and its most frequent `most` replacements."""
    w = W.partitionBy("doc_id").orderBy(F.desc("n"), "kind", "code")
    top = counts.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    lines = top.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_n", F.concat_ws(" ", "kind", "code", F.concat(F.lit("×"), "n")).alias("line")))).alias("all"))
    return status.join(lines, "doc_id", "left").select("doc_id", "status", "n_repl", "n_sus", "n_left", F.transform(F.coalesce("all", F.array().cast("array<struct<_n:int,line:string>>")), lambda x: x["line"]).alias("lines"))


def named_freely(files: DataFrame, there: DataFrame) -> DataFrame:
    """files (folder, name, hash) that aren't there yet by content, with names that nothing there has: a
    taken name gets (2), (3) and so on before its extension. Names are numbered within folder and name."""
    new = files.join(there.select("folder", "hash").distinct(), ["folder", "hash"], "left_anti").dropDuplicates(["folder", "hash"])
    stem, extension = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
    bare = F.regexp_replace(stem, r"\(\d+\)$", "")
    number = F.coalesce(F.regexp_extract(stem, r"\((\d+)\)$", 1).try_cast("int"), F.lit(1))
    used = there.withColumn("bare", bare).withColumn("extension", extension).groupBy("folder", "bare", "extension").agg(F.max(number).alias("most"))
    rows = new.withColumn("bare", bare).withColumn("extension", extension).join(used, ["folder", "bare", "extension"], "left")
    n = F.row_number().over(W.partitionBy("folder", "bare", "extension").orderBy("hash")) + F.coalesce("most", F.lit(0))
    rows = rows.withColumn("n", n)
    return rows.select("folder", "hash", "name", F.concat("bare", F.when(F.col("n") > 1, F.concat(F.lit("("), "n", F.lit(")"))).otherwise(""), "extension").alias("free"))

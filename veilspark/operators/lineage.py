"""Lineage by content hash: which sources, staged files and results belong to a job.

ledger: kind (M masked, S sent, R restored), at, h1, status, h2, ref. M links a source hash to a stage
hash, S a stage hash to a job (ref), R an output hash to a folder (ref).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def views(ledger: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = ledger.filter((F.col("kind") == "M") & (F.col("status") == "ok")).select(F.col("h1").alias("source"), F.col("h2").alias("stage"), F.col("ref").alias("report")).distinct()
    s = ledger.filter(F.col("kind") == "S").select(F.col("h1").alias("stage"), F.col("ref").alias("job")).distinct()
    r = ledger.filter(F.col("kind") == "R").select(F.col("h1").alias("output"), F.col("ref").alias("folder")).distinct()
    return m, s, r


def source_jobs(ledger: DataFrame) -> DataFrame:
    """source and the distinct jobs that it reaches over its stages."""
    m, s, _ = views(ledger)
    return m.join(s, "stage").select("source", "job").distinct()


def owned_sources(ledger: DataFrame) -> DataFrame:
    """source and job, for sources that reach exactly one job."""
    return source_jobs(ledger).groupBy("source").agg(F.min("job").alias("job"), F.count("*").alias("n")).filter("n = 1").drop("n")


def clean_plan(ledger: DataFrame, job: str) -> DataFrame:
    """item, what, include and reason for everything that touches a job: sources, stages and reports.
    Shared sources, and reports of which any source is shared, are skipped with a reason."""
    m, s, _ = views(ledger)
    reached = source_jobs(ledger)
    mine = reached.filter(F.col("job") == job).select("source")
    owned = owned_sources(ledger).filter(F.col("job") == job).select("source", F.lit(True).alias("owned"))
    sources = mine.join(owned, "source", "left").select(F.col("source").alias("item"), F.lit("source").alias("what"), F.coalesce("owned", F.lit(False)).alias("include"))
    stages = s.groupBy("stage").agg(F.min("job").alias("job"), F.max("job").alias("most")).join(s.filter(F.col("job") == job).select("stage"), "stage", "left_semi")
    stages = stages.select(F.col("stage").alias("item"), F.lit("stage").alias("what"), (F.col("job") == F.col("most")).alias("include"))
    reports = m.join(owned, "source", "left").groupBy("report").agg(F.bool_and(F.coalesce("owned", F.lit(False))).alias("include"), F.bool_or(F.col("owned").isNotNull()).alias("touched")).filter("touched and report is not null")
    reports = reports.select(F.col("report").alias("item"), F.lit("report").alias("what"), "include")
    every = sources.unionByName(stages).unionByName(reports)
    return every.withColumn("reason", F.when(~F.col("include"), F.concat(F.lit("shared "), "what")))


def shortest_names(files: DataFrame) -> DataFrame:
    """One row for each content hash of files (hash, name): the shortest name."""
    return files.groupBy("hash").agg(F.min_by("name", F.struct(F.length("name"), F.col("name"))).alias("name"), F.count("*").alias("copies"))


def new_files(files: DataFrame, there: DataFrame) -> DataFrame:
    """Files (size, hash, name) whose content isn't there yet; size and hash both join."""
    return files.join(there.select("size", "hash").distinct(), ["size", "hash"], "left_anti")


def tree_signature(files: DataFrame) -> DataFrame:
    """root and a signature of its files (root, path, size, hash): hashes are summed as 128 bits, so that
    no task gets a whole tree."""
    row = F.sha2(F.concat_ws("|", "path", F.col("size").cast("string"), "hash"), 256)
    halves = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = [F.sum(h).alias(f"s{i}") for i, h in enumerate(halves)]
    return files.groupBy("root").agg(F.count("*").alias("n"), *sums).select("root", F.sha2(F.concat_ws("|", "n", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("signature"))


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that a and b don't hold equally often, as often as they are too many: side, and the columns of
    a. Both sides meet in one signed count."""
    columns = a.columns
    signed = a.withColumn("_n", F.lit(1)).unionByName(b.select(*columns).withColumn("_n", F.lit(-1)))
    off = signed.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    rows = off.withColumn("side", F.when(F.col("_n") > 0, "left").otherwise("right")).withColumn("_one", F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int"))))
    return rows.select(*columns, "side")


def send_gate(files: DataFrame) -> DataFrame:
    """doc_id and the first reason not to send it. files: doc_id, pending, registered (matches left),
    users (array of codes found), chosen (code), suspects, confirmed."""
    own = F.array_contains("users", F.col("chosen"))
    others = F.size("users") > F.when(own, 1).otherwise(0)

    def why(test: Column, reason: str) -> Column:
        return F.when(test, reason)

    return files.select("doc_id", F.coalesce(
        why(F.col("pending") > 0, "unprocessed sources"), why(F.col("registered") > 0, "registered word left"), why((F.size("users") == 0) & ~F.col("confirmed"), "no user found"),
        why((F.size("users") > 0) & ~own, "other user"), why(own & others & ~F.col("confirmed"), "mixed users"), why(F.col("suspects") > 0, "suspect in note"),
    ).alias("reason"))

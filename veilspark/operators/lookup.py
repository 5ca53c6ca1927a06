"""Lookups with validity: people by normalised name, the certificate valid on a day or else the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_width, katakana, norm_space


def name_key(c: Column) -> Column:
    return norm_space(half_width(F.regexp_replace(c, "﻿", "")))


def valid_or_newest(certs: DataFrame, key: list[str], on: Column, start: str = "start", end: str = "end") -> DataFrame:
    """One row for each key: the row valid on the day (both ends count) with the latest start, else the
    row with the latest start. Adds valid and why (expired, not started, unreadable). Rows are chosen by
    an aggregate, so a hot key is reduced before it is shuffled."""
    begin, until = F.col(start), F.col(end)
    valid = F.coalesce((begin <= on) & (until.isNull() | (on <= until)), F.lit(False))
    rest = [c for c in certs.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(valid.cast("int"), begin, until, F.struct(*[F.col(c).cast("string") for c in rest])))
    rows = certs.groupBy(*key).agg(best.alias("r"), F.count("*").alias("n_rows")).select(*key, "r.*", "n_rows")
    return rows.withColumn("valid", valid).withColumn("why", F.when(valid, F.lit(None).cast("string")).when(begin.isNull(), "unreadable").when(begin > on, "not started").otherwise("expired"))


def people(persons: DataFrame) -> DataFrame:
    """key and the one person of that name, or why there is none: readings differ, or the same reading
    with different birth or address."""
    rows = persons.withColumn("key", name_key(F.col("name"))).withColumn("reading", katakana(norm_space(F.col("kana"))))
    by = rows.groupBy("key").agg(F.count_distinct("reading").alias("readings"), F.count_distinct("birth", "address").alias("others"), F.min(F.struct("name", "reading", "birth", "address")).alias("r"))
    why = F.when(F.col("readings") > 1, "ambiguous").when(F.col("others") > 1, "conflict")
    return by.select("key", *[F.when(why.isNull(), F.col(f"r.{c}")).alias(c) for c in ("name", "reading", "birth", "address")], why.alias("why"))


def find(wanted: DataFrame, persons: DataFrame, certs: DataFrame, on: Column) -> DataFrame:
    """Each wanted name with its person and certificate, or the reason why not."""
    best = valid_or_newest(certs.withColumn("key", name_key(F.col("name"))).select("key", "level", "start", "end"), ["key"], on)
    asked = wanted.select("name", name_key(F.col("name")).alias("key"))
    found = asked.join(people(persons).withColumnRenamed("name", "full_name"), "key", "left").join(best.withColumnRenamed("why", "cert_why"), "key", "left")
    reason = F.when(F.col("full_name").isNull() & F.col("why").isNull(), "not found").otherwise(F.coalesce("why", "cert_why"))
    return found.select("name", "full_name", "reading", "birth", "address", "level", "start", "end", "valid", reason.alias("reason"))

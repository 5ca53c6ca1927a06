"""Masking a batch: spans, codes, masked texts, and the gates that hold a document back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import KINDS, candidates
from ..storage import kept
from . import codebook
from .spans import fold, replaced

UNIT = ("doc_id", "part_no", "seq")
#: Column of a unit's accepted spans.
FOUND = "_found"


@dataclass
class Masked:
    """Lazy relations of one batch."""

    units: DataFrame
    spans: DataFrame
    delta: DataFrame


def with_spans(units: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """units with FOUND, the accepted shape spans of each text."""
    return units.withColumn(FOUND, fold(candidates(F.col("text"), kinds), F.col("text")))


def spans_of(found: DataFrame) -> DataFrame:
    """The spans in FOUND, a row for each: UNIT, st, len, kind, orig, space."""
    rows = found.select(*UNIT, F.explode(FOUND).alias("s"))
    return rows.select(*UNIT, "s.st", "s.len", "s.kind", "s.orig", F.lit("型").alias("space"))


def find_spans(units: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Accepted shape spans of units (UNIT and text): UNIT, st, len, kind, orig, space."""
    return spans_of(with_spans(units, kinds))


def apply_spans(units: DataFrame, coded: DataFrame, some: Column | None = None) -> DataFrame:
    """units with `masked`: their text with each coded span replaced. some: whether a row can have spans at
    all; the other rows then take no part in the join."""
    by_unit = coded.groupBy(*UNIT).agg(F.array_sort(F.collect_list(F.struct("st", "len", "code"))).alias("spans"))
    joined = (units if some is None else units.filter(some)).join(by_unit, list(UNIT), "left")
    out = joined.withColumn("masked", F.when(F.col("spans").isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col("spans")))).drop("spans")
    return out if some is None else out.unionByName(units.filter(~F.coalesce(some, F.lit(False))).withColumn("masked", F.col("text")))


def apply_found(found: DataFrame, coded: DataFrame) -> DataFrame:
    """Units with FOUND and `masked`; only texts with a span meet their codes, the others stay where they are."""
    return apply_spans(found, coded, F.size(FOUND) > 0).drop(FOUND)


def mask(units: DataFrame, book: DataFrame, kinds: tuple[str, ...] = KINDS) -> Masked:
    """Spans are found once and written with their texts."""
    found = kept(with_spans(units, kinds), "found")
    spans = spans_of(found)
    delta = kept(codebook.allocate(spans, book), "codebook")
    return Masked(apply_found(found, codebook.with_codes(spans, book.unionByName(delta))), spans, delta)


def file_status(units: DataFrame, spans: DataFrame, suspects: DataFrame, left: DataFrame) -> DataFrame:
    """doc_id, status and counts: a leftover makes a document `err`, a suspect holds it, else it is `ok`."""
    names = ("n_repl", "n_sus", "n_left")
    rows = units.select("doc_id", *[F.lit(0).alias(n) for n in names])
    for df, name in zip((spans, suspects, left), names, strict=True):
        rows = rows.unionByName(df.select("doc_id", *[F.lit(int(n == name)).alias(n) for n in names]))
    out = rows.groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in names])
    return out.withColumn("status", F.when(F.col("n_left") > 0, "err").when(F.col("n_sus") > 0, "held").otherwise("ok"))


def replacement_counts(coded: DataFrame) -> DataFrame:
    return coded.groupBy("doc_id", "kind", "orig", "code").agg(F.count("*").alias("n"))

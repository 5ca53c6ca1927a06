"""Fixed-shape sheets: day records, forms recognised by their labels, dates of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ERAS, flexible_date, valid_date

# The cells of a day record.
DAY_CELLS = {"code": "D2", "era_year": "L2", "month": "N2", "day": "P2", "weekday": "S2", "kind": "C4", "time": "M4", "place": "C5", "partner": "M5", "purpose": "C6", "body": "A7"}
SUFFIXES = "②③④⑤⑥⑦⑧⑨⑩"


def wide(cells: DataFrame, refs: dict[str, str]) -> DataFrame:
    """One row for a sheet with the named cells as columns; only these cells are shuffled."""
    rows = cells.filter(F.col("ref").isin(*refs.values()))
    return rows.groupBy("doc_id", "sheet").agg(*[F.max(F.when(F.col("ref") == ref, F.col("text"))).alias(name) for name, ref in refs.items()])


def day_records(cells: DataFrame) -> DataFrame:
    """Day records of sheets named month.day with an optional circled number: date, nth and the fields;
    problem says why a sheet isn't one (its date is none, or isn't the one of its name)."""
    rows = wide(cells, DAY_CELLS)
    shape = rf"^(\d{{1,2}})\.(\d{{1,2}})([{SUFFIXES}]?)$"
    rows = rows.filter(F.col("sheet").rlike(shape))
    date = valid_date(F.col("era_year").try_cast("int") + ERAS[-1][2], F.col("month").try_cast("int"), F.col("day").try_cast("int"))
    nth = F.greatest(F.instr(F.lit("①" + SUFFIXES), F.regexp_extract("sheet", shape, 3)), F.lit(1))
    rows = rows.withColumn("date", date).withColumn("nth", nth)
    named = (F.regexp_extract("sheet", shape, 1).cast("int") == F.month("date")) & (F.regexp_extract("sheet", shape, 2).cast("int") == F.dayofmonth("date"))
    return rows.withColumn("problem", F.when(F.col("date").isNull(), "no date").when(~named, "sheet name is another day"))


def newest_days(records: DataFrame) -> DataFrame:
    """Good records of a book, newest first: place counts from 1."""
    w = W.partitionBy("doc_id").orderBy(F.desc("date"), F.desc("nth"))
    return records.filter("problem is null").withColumn("place", F.row_number().over(w))


def duplicate_days(records: DataFrame) -> DataFrame:
    """Records of one day and book with equal bodies: all but the first."""
    w = W.partitionBy("doc_id", "date", "body").orderBy("nth", "sheet")
    return records.withColumn("_n", F.row_number().over(w)).filter("_n > 1").drop("_n")


def recognised(cells: DataFrame, labels: dict[str, str]) -> DataFrame:
    """doc_id and sheet of sheets that hold each label (ref: text, white space aside) at its place."""
    rows = cells.filter(F.col("ref").isin(*labels))
    good: Column = F.lit(False)
    for ref, text in labels.items():
        good = good | ((F.col("ref") == ref) & (F.regexp_replace("text", r"[\s　]", "") == text))
    return rows.filter(good).groupBy("doc_id", "sheet").agg(F.count_distinct("ref").alias("n")).filter(F.col("n") == len(labels)).select("doc_id", "sheet")


def first_dates(cells: DataFrame, refs: tuple[str, ...]) -> DataFrame:
    """The first date, in the order of refs, that a sheet's cells hold."""
    order = F.array_position(F.array(*map(F.lit, refs)), F.col("ref"))
    rows = cells.filter(F.col("ref").isin(*refs)).withColumn("date", flexible_date(F.col("text"))).filter("date is not null")
    return rows.groupBy("doc_id", "sheet").agg(F.min_by("date", order).alias("date"))


def previous_value(forms: DataFrame) -> DataFrame:
    """For each form (owner, date, value) without a value the one of the newest earlier form that has one."""
    w = W.partitionBy("owner").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    held = F.last(F.when(F.col("value") != "", F.col("value")), ignorenulls=True).over(w)
    return forms.withColumn("filled", F.when(F.coalesce("value", F.lit("")) == "", held).otherwise(F.col("value")))


def visible(cells: DataFrame) -> DataFrame:
    """Cells of shown sheets, one text for a row: its cells from left to right, tabs between."""
    from .cells import addressed

    rows = addressed(cells.filter("not hidden")).filter(F.col("text") != "")
    by = rows.groupBy("doc_id", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("all"))
    return by.select("doc_id", "sheet", "row", F.array_join(F.transform("all", lambda c: c["text"]), "\t").alias("text"))


def hidden_only(cells: DataFrame) -> DataFrame:
    """Texts that only hidden sheets hold."""
    return cells.filter("hidden").select("doc_id", "text").distinct().join(cells.filter("not hidden").select("doc_id", "text").distinct(), ["doc_id", "text"], "left_anti")

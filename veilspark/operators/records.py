"""Books of dated records: pages, index rows, inferred years, OCR rows, sheet names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import display_width, line_cost

LINES, WIDTH = 33, 48


def paginated(records: DataFrame, lines: int = LINES, width: int = WIDTH) -> DataFrame:
    """record_id, page, paras: the paragraphs of each record (array `paras`) on pages of `lines` lines of
    `width`; later pages lose a line to the heading that says they continue. A paragraph longer than a
    page goes on by itself."""
    pages = "array<array<string>>"

    def step(acc: Column, p: Column) -> Column:
        cost = line_cost(p, width)
        room = F.when(F.size(acc["done"]) == 0, lines).otherwise(lines - 1)
        fits = (acc["used"] + cost <= room) | (F.size(acc["page"]) == 0)
        same = F.struct(acc["done"].alias("done"), F.concat(acc["page"], F.array(p)).alias("page"), (acc["used"] + cost).alias("used"))
        new = F.struct(F.concat(acc["done"], F.array(acc["page"])).alias("done"), F.array(p).alias("page"), cost.alias("used"))
        return F.when(fits, same).otherwise(new)

    start = F.struct(F.array().cast(pages).alias("done"), F.array().cast("array<string>").alias("page"), F.lit(0).alias("used"))
    done = F.aggregate("paras", start, step, lambda acc: F.when(F.size(acc["page"]) > 0, F.concat(acc["done"], F.array(acc["page"]))).otherwise(acc["done"]))
    return records.select("record_id", F.posexplode(done).alias("page", "paras")).withColumn("page", F.col("page") + 1)


def chunked(records: DataFrame, per_row: int = 20, width: int = 32) -> DataFrame:
    """record_id, chunk, paras, lines: index rows of at most `per_row` estimated lines; a paragraph that
    is longer is cut every per_row * width characters."""
    cut = per_row * width
    pieces = F.flatten(F.transform("paras", lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(p) / cut).cast("int") - 1, F.lit(0))), lambda i: F.substring(p, i * cut + 1, F.lit(cut)))))
    flat = records.select("record_id", F.posexplode(pieces).alias("pos", "para"))
    flat = flat.withColumn("lines", F.greatest(F.lit(1), F.ceil(display_width(F.col("para")) / width)).cast("int"))
    by = flat.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("pos", "para", "lines"))).alias("all"))

    def step(acc: Column, p: Column) -> Column:
        full = acc["used"] + p["lines"] > per_row
        n = F.when(full & (acc["used"] > 0), acc["n"] + 1).otherwise(acc["n"])
        used = F.when(full & (acc["used"] > 0), p["lines"]).otherwise(acc["used"] + p["lines"])
        return F.struct(n.alias("n"), used.alias("used"), F.concat(acc["out"], F.array(F.struct(n.alias("chunk"), p["para"].alias("para"), p["lines"].alias("lines")))).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.array().cast("array<struct<chunk:int,para:string,lines:int>>").alias("out"))
    rows = by.select("record_id", F.posexplode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("at", "r"))
    return rows.groupBy("record_id", F.col("r.chunk").alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("r.para").alias("para")))), lambda x: x["para"]).alias("paras"), F.sum("r.lines").cast("int").alias("lines"))


def list_rows(days: DataFrame) -> DataFrame:
    """Index rows of day records (day, nth, kind, paras): date and kind stand on the first row of a
    record only; sort_key is yyyymmdd-nn."""
    rows = days.select("day", "nth", "kind", F.posexplode("paras").alias("pos", "body"))
    key = F.concat(F.date_format("day", "yyyyMMdd"), F.lit("-"), F.lpad(F.col("nth").cast("string"), 2, "0"))
    return rows.select(F.when(F.col("pos") == 0, F.col("day")).alias("date"), F.when(F.col("pos") == 0, F.col("kind")).alias("kind"), "body", key.alias("sort_key"), (F.col("pos") > 0).cast("int").alias("continuation"), "pos")


def inferred_years(entries: DataFrame, this_year: int, this_month: int) -> DataFrame:
    """Add year to entries (book, row, month, marked_year): rows stand newest first. From a marked year
    the year falls by one downwards where the month rises, and above the first mark rises by one where
    the month falls; without any mark the first row is this year's, or last year's if its month is yet
    to come. A book's rows are one window."""
    w = W.partitionBy("book").orderBy("row")
    fall = F.coalesce((F.col("month") > F.lag("month").over(w)).cast("int"), F.lit(0))
    rows = entries.withColumn("falls", F.sum(fall).over(w)).withColumn("mark", F.col("marked_year").isNotNull())
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    after = w.rowsBetween(0, W.unboundedFollowing)
    base = F.struct("marked_year", "falls")
    rows = rows.withColumn("above", F.last(F.when(F.col("mark"), base), ignorenulls=True).over(upto)).withColumn("below", F.first(F.when(F.col("mark"), base), ignorenulls=True).over(after))
    top = F.first("month").over(upto)
    start = F.lit(this_year) - (top > this_month).cast("int")
    year = F.coalesce(F.col("above.marked_year") - (F.col("falls") - F.col("above.falls")), F.col("below.marked_year") + (F.col("below.falls") - F.col("falls")), start - F.col("falls"))
    return rows.withColumn("year", year.cast("int")).drop("falls", "mark", "above", "below")


def ocr_lines(text: DataFrame) -> DataFrame:
    """Lines of OCR output (doc_id, n, line): page, y, x, h, text. `#PAGE` lines start a page."""
    w = W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    rows = text.withColumn("page", F.sum(F.col("line").startswith("#PAGE").cast("int")).over(w)).filter(~F.col("line").startswith("#PAGE") & (F.size(F.split("line", "\t")) >= 4))
    part = F.split("line", "\t", 4)
    return rows.select("doc_id", F.greatest("page", F.lit(1)).cast("int").alias("page"), *[part[i].try_cast("double").alias(c) for i, c in enumerate("yxh")], part[3].alias("text")).filter("y is not null and x is not null")


def ocr_rows(lines: DataFrame, least: float = 8.0) -> DataFrame:
    """doc_id, page, row, text: lines whose y is within max(least, half the height) of the row's first
    line are one row; its pieces are joined from left to right."""
    by = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("y", "x", "h", "text"))).alias("all"))

    def step(acc: Column, p: Column) -> Column:
        same = (acc["n"] > 0) & (p["y"] - acc["y"] <= F.greatest(F.lit(least), acc["h"] / 2))
        n = F.when(same, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(n.alias("n"), F.when(same, acc["y"]).otherwise(p["y"]).alias("y"), F.when(same, acc["h"]).otherwise(p["h"]).alias("h"), F.concat(acc["out"], F.array(F.struct(n.alias("row"), p["x"].alias("x"), p["text"].alias("text")))).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("y"), F.lit(0.0).alias("h"), F.array().cast("array<struct<row:int,x:double,text:string>>").alias("out"))
    rows = by.select("doc_id", "page", F.explode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("r"))
    return rows.groupBy("doc_id", "page", F.col("r.row").alias("row")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r.x", "r.text"))), lambda s: s["text"]), "　").alias("text"))


def poor_pages(rows: DataFrame, wide: int = 10, hiragana: int = 5) -> DataFrame:
    """Pages with at least so many wide characters but fewer hiragana: badly read ones."""
    count = F.sum(F.length(F.regexp_replace("text", r"[^\p{IsHiragana}]", "")))
    wides = F.sum(F.length(F.regexp_replace("text", r"[\x00-\xff]", "")))
    return rows.groupBy("doc_id", "page").agg(wides.alias("wide"), count.alias("hiragana")).filter((F.col("wide") >= wide) & (F.col("hiragana") < hiragana))


def free_names(wanted: DataFrame, used: DataFrame) -> DataFrame:
    """Add free to wanted (book, name): the name, or with the first suffix ②–⑩ that the book hasn't used."""
    suffixes = F.array(*[F.lit(s) for s in ("", *"②③④⑤⑥⑦⑧⑨⑩")])
    tried = wanted.select("book", "name", F.posexplode(suffixes).alias("nth", "suffix")).withColumn("free", F.concat("name", "suffix"))
    left = tried.join(used.select("book", F.col("name").alias("free")), ["book", "free"], "left_anti")
    return left.groupBy("book", "name").agg(F.min_by("free", "nth").alias("free"))

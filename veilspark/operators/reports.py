"""What a run reports and decides from its own tables: counts, guides, names that are free, work that is
left, registered dates in any spelling, and values of cells that become names of their workbook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patterns import DATE, located
from ..functions.text import flexible_date, norm_name
from ..storage import shuffled
from .mask import UNIT
from .suspects import category

#: Glyphs of names and the one that they are compared by.
GLYPHS = {
    "高": "髙", "崎": "﨑嵜", "辺": "邊邉", "沢": "澤", "浜": "濱濵", "斉": "斎齋齊", "広": "廣", "島": "嶋嶌", "桜": "櫻", "恵": "惠", "国": "國", "真": "眞", "徳": "德", "吉": "𠮷", "富": "冨", "桑": "桒", "槙": "槇", "栄": "榮", "万": "萬", "与": "與", "竜": "龍", "滝": "瀧", "関": "關", "塩": "鹽", "芦": "蘆", "鉄": "鐵", "豊": "豐",
}
CIRCLED = "②③④⑤⑥⑦⑧⑨⑩"


def glyph_key(c: Column) -> Column:
    """A name with glyph variants made equal; lengths and places stay."""
    return F.translate(c, "".join(GLYPHS.values()), "".join(k * len(v) for k, v in GLYPHS.items()))


def variant_names(words: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Words (`word`) that are a surface in other glyphs: word, surface."""
    own = surfaces.select("surface", glyph_key(F.col("surface")).alias("key")).distinct()
    return words.select("word").distinct().withColumn("key", glyph_key(F.col("word"))).join(own, "key").filter(F.col("word") != F.col("surface")).select("word", "surface")


def registered_dates(units: DataFrame, dates: DataFrame) -> DataFrame:
    """Dates in units that are a registered one (date, owner) in whatever spelling: UNIT, st, orig, date,
    owner. Texts and registry meet by the date, not by its spellings."""
    found = units.select(*UNIT, F.explode(located(F.col("text"), DATE)).alias("m")).select(*UNIT, "m.st", "m.orig", flexible_date(F.col("m.orig")).alias("date"))
    return found.filter("date is not null").join(dates.select("date", "owner").distinct(), "date")


def workbook_names(cells: DataFrame, registered: DataFrame) -> DataFrame:
    """Values of registered cells that become names in their own workbook: doc_id, surface, label. Numbers,
    short and blank values don't. cells: doc_id, sheet, ref, type, text; registered: doc_id, sheet, ref,
    label."""
    values = cells.join(registered.select("doc_id", "sheet", "ref", "label"), ["doc_id", "sheet", "ref"])
    surface = norm_name(F.trim("text"))
    return values.filter(~F.col("type").isin("b", "e", "n") & (F.length(surface) >= 2) & ~surface.rlike(r"^[0-9０-９./-]+$")).select("doc_id", surface.alias("surface"), "label").distinct()


def later_mentions(units: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Where a document's units hold one of its own workbook names: UNIT, surface, label. The names of a
    document meet its units by doc_id."""
    return units.select(*UNIT, "text").join(surfaces, "doc_id").filter(norm_name(F.col("text")).contains(F.col("surface"))).select(*UNIT, "surface", "label")


def suspect_counts(suspects: DataFrame) -> DataFrame:
    """doc_id, category, n and place: how many suspects of each category a document has, in the order in
    which the categories first appear. suspects: doc_id, part_no, seq, st, reason."""
    by = suspects.groupBy("doc_id", category(F.col("reason")).alias("category")).agg(F.count("*").alias("n"), F.min(F.struct("part_no", "seq", "st")).alias("first"))
    return by.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("first", "category"))).drop("first")


def leftover_guides(leftovers: DataFrame) -> DataFrame:
    """kind, n and whether any needs the registry: leftovers (kind, at, registered) by kind, first seen
    first."""
    by = leftovers.groupBy("kind").agg(F.count("*").alias("n"), F.bool_or("registered").alias("registered"), F.min("at").alias("first"))
    return by.withColumn("place", F.rank().over(W.orderBy("first"))).drop("first")


def rows_with_codes(registry: DataFrame, book: DataFrame) -> DataFrame:
    """Registry rows with the code of their name and how many rows share kind and name."""
    norm = norm_name(F.col("name"))
    codes = book.filter(F.col("key").startswith("名|")).select(F.element_at(F.split("key", r"\|"), -1).alias("norm"), "code")
    same = registry.groupBy("kind", norm.alias("norm")).agg(F.count("*").alias("n_same"))
    return registry.withColumn("norm", norm).join(same, ["kind", "norm"]).join(codes, "norm", "left").select("row_no", "kind", "name", "code", "n_same")


def new_aliases(rows: DataFrame) -> DataFrame:
    """rows (old, target: arrays) with the aliases that target adds, name spaces aside."""
    return rows.withColumn("added", F.filter("target", lambda a: ~F.exists("old", lambda o: norm_name(o) == norm_name(a))))


def rename_collisions(files: DataFrame) -> DataFrame:
    """Files (dir, from, to) whose new name another file of the folder gets or has, with how many do."""
    taken = files.groupBy("dir", "to").agg(F.count("*").alias("n"))
    stays = files.filter(F.col("from") == F.col("to")).select("dir", "to").distinct().withColumn("is_there", F.lit(True))
    met = files.filter(F.col("from") != F.col("to")).join(shuffled(taken), ["dir", "to"]).join(shuffled(stays), ["dir", "to"], "left")
    return met.filter((F.col("n") > 1) | F.coalesce("is_there", F.lit(False))).select("dir", "from", "to", "n")


def free_job_names(wanted: DataFrame, used: DataFrame, most: int = 20) -> DataFrame:
    """wanted (user, day) with name, the first of `most` numbered names of the day that the user hasn't
    used, null if all are: 2024-04-01, 2024-04-01_2, ..."""
    base = F.date_format("day", "yyyy-MM-dd")
    numbered = wanted.select("user", "day", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k")).withColumn("name", F.when(F.col("k") == 1, base).otherwise(F.concat(base, F.lit("_"), F.col("k").cast("string"))))
    free = numbered.join(used.select("user", "name"), ["user", "name"], "left_anti").groupBy("user", "day").agg(F.min_by("name", "k").alias("name"))
    return wanted.join(free, ["user", "day"], "left")


def unfinished_jobs(ledger: DataFrame) -> DataFrame:
    """Stages that were sent (S: h1, ref is the job) and have no result (R: ref is the job) yet: job, n."""
    sent = ledger.filter("kind = 'S'").groupBy(F.col("ref").alias("job")).agg(F.count_distinct("h1").alias("n"))
    return sent.join(ledger.filter("kind = 'R'").select(F.col("h2").alias("job")).distinct(), "job", "left_anti")


def restored_counts(restored: DataFrame) -> DataFrame:
    """doc_id, n_units with a restored code, n_unknown and the unknown codes of each document. restored:
    doc_id, text, restored, unknown."""
    changed = (F.col("restored") != F.col("text")).cast("int")
    return restored.groupBy("doc_id").agg(F.sum(changed).alias("n_units"), F.sum(F.size("unknown")).alias("n_unknown"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("unknown")))).alias("unknown"))


def inserted_newest_first(book: DataFrame, new: DataFrame) -> DataFrame:
    """Index rows (book, date, nth, body) with the new ones in their places, newest first, and the row
    number that each then has. A day's record that is there already is replaced."""
    kept = book.join(new.select("book", "date", "nth").distinct(), ["book", "date", "nth"], "left_anti")
    every = kept.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))
    return every.withColumn("row", F.row_number().over(W.partitionBy("book").orderBy(F.desc("date"), F.desc("nth"))))


def next_in_day(book: DataFrame, new: DataFrame) -> DataFrame:
    """new (book, date, body) with nth, counted on from the day's records in the book, and the name of its
    sheet: month.day with a circled number from the second on."""
    there = book.groupBy("book", "date").agg(F.max("nth").alias("most"))
    nth = F.row_number().over(W.partitionBy("book", "date").orderBy("body")) + F.coalesce("most", F.lit(0))
    rows = new.join(there, ["book", "date"], "left").withColumn("nth", nth).drop("most")
    mark = F.when(F.col("nth") == 1, "").otherwise(F.substring(F.lit(CIRCLED), F.col("nth").cast("int") - 1, F.lit(1)))
    return rows.withColumn("sheet", F.concat(F.month("date").cast("string"), F.lit("."), F.dayofmonth("date").cast("string"), mark))

"""Cells of workbooks: registered cells and what depends on them, neighbours of a label.

cells: doc_id, sheet, ref, row, col, type (s, inlineStr, str, n, b, e), text, formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cell_column, cell_row
from ..storage import dimension_join, kept, shuffled

#: Rounds in which a formula that refers to a registered cell is registered itself.
ROUNDS = 6
PLACEHOLDERS = ("なし", "無し", "無", "同上", "不明", "該当なし", "特になし", "-", "ー")
REFERENCE = r"(?:'[^']+'!|[^\s'!()+*/,:=<>&\-]+!)?\$?[A-Z]{1,3}\$?[0-9]{1,7}"


def references(cells: DataFrame) -> DataFrame:
    """Edges of the formula graph: doc_id, src_sheet, src_ref (the formula), dst_sheet, dst_ref."""
    found = cells.filter(F.col("formula").isNotNull()).select("doc_id", F.col("sheet").alias("src_sheet"), F.col("ref").alias("src_ref"), F.explode(F.regexp_extract_all("formula", F.lit(REFERENCE), F.lit(0))).alias("to"))
    bare = F.regexp_replace("to", r"\$", "")
    sheet = F.regexp_replace(F.regexp_extract(bare, "^(.*)!", 1), "^'|'$", "")
    return found.select("doc_id", "src_sheet", "src_ref", F.when(sheet == "", F.col("src_sheet")).otherwise(sheet).alias("dst_sheet"), F.regexp_extract(bare, "([A-Z]+[0-9]+)$", 1).alias("dst_ref")).distinct()


def registered(cells: DataFrame, targets: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, sheet, ref, label, round: configured cells (sheet, ref, label) of every workbook, and the
    formulas that reach them within `rounds` steps. Each round adds only new cells."""
    edges = kept(references(cells), "references")
    frontier = dimension_join(cells.select("doc_id", "sheet", "ref"), targets.select("sheet", "ref", "label"), ["sheet", "ref"]).select("doc_id", "sheet", "ref", "label").withColumn("round", F.lit(0))
    found = kept(frontier, "registered")
    frontier = found
    for n in range(1, rounds + 1):
        step = edges.join(shuffled(frontier.select("doc_id", F.col("sheet").alias("dst_sheet"), F.col("ref").alias("dst_ref"), "label")), ["doc_id", "dst_sheet", "dst_ref"])
        step = step.groupBy("doc_id", F.col("src_sheet").alias("sheet"), F.col("src_ref").alias("ref")).agg(F.min("label").alias("label"))
        frontier = kept(step.join(shuffled(found.select("doc_id", "sheet", "ref")), ["doc_id", "sheet", "ref"], "left_anti").withColumn("round", F.lit(n)), "registered")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def masked(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Registered cells with the namespace of their key: numbers, formula values and texts. Blank and
    placeholder values, booleans and errors stay as they are."""
    value = F.trim("text")
    space = F.when(F.col("type") == "n", "数").when(F.col("formula").isNotNull(), "値").otherwise("文")
    stays = F.col("type").isin("b", "e") | (value == "") | F.col("text").isNull() | value.isin(*PLACEHOLDERS)
    return cells.join(found.select("doc_id", "sheet", "ref", "label"), ["doc_id", "sheet", "ref"]).filter(~stays).select("doc_id", "sheet", "ref", F.col("label").alias("kind"), F.col("text").alias("orig"), space.alias("space"))


def beside_label(cells: DataFrame, label: str = "生年月日", within: int = 12) -> DataFrame:
    """Cells right of a label in its row or below it in its column, at most `within` cells away. The
    labels' few rows are spread over the cells they reach, and meet them by equality."""
    at = cells.filter(F.regexp_replace("text", r"[\s　：:]", "") == label).select("doc_id", "sheet", F.col("row").alias("l_row"), F.col("col").alias("l_col"))
    reach = F.array(*[F.struct((F.col("l_row") + dr).alias("row"), (F.col("l_col") + dc).alias("col"), F.lit(dr + dc).alias("distance")) for d in range(1, within + 1) for dr, dc in ((0, d), (d, 0))])
    spread = at.select("doc_id", "sheet", F.explode(reach).alias("r")).select("doc_id", "sheet", "r.*").groupBy("doc_id", "sheet", "row", "col").agg(F.min("distance").alias("distance"))
    return cells.join(shuffled(spread), ["doc_id", "sheet", "row", "col"]).filter(F.trim("text") != "")


def long_numbers(cells: DataFrame, excluded: DataFrame) -> DataFrame:
    """Numeric cells of at least 8 digits that aren't excluded."""
    return cells.filter((F.col("type") == "n") & F.col("text").rlike(r"^[0-9]{8,}$")).join(excluded.select(F.col("word").alias("text")), "text", "left_anti")


def addressed(rows: DataFrame) -> DataFrame:
    """Add row and col from ref."""
    return rows.withColumn("row", cell_row(F.col("ref"))).withColumn("col", cell_column(F.col("ref")))


def target_list(config: DataFrame) -> DataFrame:
    """sheet, label, ref from rows of a config (sheet, label, cells): refs split at commas or spaces."""
    refs = F.filter(F.split(F.regexp_replace("cells", r"\$", ""), "[,、， ]+"), lambda r: r != "")
    return config.filter(~F.col("sheet").startswith("#")).select("sheet", "label", F.explode(refs).alias("ref"))


def enclosing(marks: DataFrame, spans: DataFrame, bin_size: int = 256) -> DataFrame:
    """Each mark (doc_id, pos) with the innermost span (doc_id, start, end, name) that holds it. Spans
    are spread over bins of positions, so that containment becomes an equality with a check."""
    spread = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.greatest("start", F.col("end") - 1) / bin_size))))
    met = marks.withColumn("bin", F.floor(F.col("pos") / bin_size)).join(spread, ["doc_id", "bin"]).filter((F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("end")))
    return met.groupBy("doc_id", "pos").agg(F.min_by(F.struct("name", "start", "end"), F.struct(F.col("end") - F.col("start"), F.col("start"))).alias("s")).select("doc_id", "pos", "s.*")


def restored_number(code: Column, restore: Column, is_numeric: Column) -> Column:
    """The cell type that a restored code gets."""
    return F.when(is_numeric & restore.try_cast("double").isNotNull(), F.struct(F.lit("n").alias("type"), restore.alias("value"))).otherwise(F.struct(F.lit("inlineStr").alias("type"), F.coalesce(restore, code).alias("value")))

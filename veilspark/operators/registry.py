"""The registry of people and addresses: its dictionary, merging of duplicates, owners of words.

registry: row_no, kind, name, aliases (array), reading. Kinds 除外 (excluded) and 住所 (address)
aren't people.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.address import registered_core
from ..functions.text import MASK_GLYPHS, hiragana, katakana, mask_key, norm_name
from ..storage import shuffled

EXCLUDED, ADDRESS = "除外", "住所"
HONORIFIC = "(?:様|さま|さん|氏|殿|ちゃん|くん|君)"
#: What must follow: nothing, an honorific, or an honorific or a word for a house.
FREE, TITLED, HOUSED = "free", "titled", "housed"
FOLLOWS = {TITLED: f"^[ 　]?{HONORIFIC}", HOUSED: f"^[ 　]?(?:{HONORIFIC}|宅|家|邸)"}


def people(registry: DataFrame) -> DataFrame:
    return registry.filter(~F.col("kind").isin(EXCLUDED, ADDRESS) & (norm_name(F.col("name")) != ""))


def exclusions(registry: DataFrame) -> DataFrame:
    """Excluded words as written and without spaces; words of one character apart (`single`)."""
    words = registry.filter(F.col("kind") == EXCLUDED).select(F.explode(F.array(F.trim("name"), norm_name(F.col("name")))).alias("word")).filter("word <> ''").distinct()
    return words.withColumn("single", F.length("word") == 1)


def addresses(registry: DataFrame) -> DataFrame:
    """Canonical cores of registered addresses; rows without a lot number don't count."""
    return registry.filter(F.col("kind") == ADDRESS).select(registered_core(F.col("name")).alias("core"), F.col("name").alias("orig")).filter("core is not null").dropDuplicates(["core"])


def dictionary(registry: DataFrame) -> DataFrame:
    """surface, space, prefix, orig, base, needs: every spelling that stands for a registered person.

    Names are split at spaces into surname and given name; a surname's entry is shared by all who bear
    it. The first row to register a surface keeps it."""
    rows = people(registry).select("row_no", F.col("kind").alias("prefix"), F.trim("name").alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("reading", F.lit("")).alias("reading"))
    parts = F.filter(F.split("name", "[ 　]+"), lambda p: p != "")
    splits = (F.size(parts) >= 2) & ~F.exists(parts, lambda p: p.rlike("[1-9１-９/／]") | ~p.rlike(r"\p{L}"))

    def entry(surface: Column, space: str, key: Column, rank: int, needs: Column | None = None) -> Column:
        by_length = F.when(F.length(surface) == 1, TITLED).otherwise(FREE)
        return F.struct(surface.alias("surface"), F.lit(space).alias("space"), key.alias("key"), F.lit(rank).alias("rank"), F.coalesce(needs if needs is not None else F.lit(None).cast("string"), by_length).alias("needs"))

    def spellings(whole: Column) -> Column:
        return F.array_distinct(F.array(whole, norm_name(whole), F.regexp_replace(whole, "[ 　]+", " "), F.regexp_replace(whole, "[ 　]+", "　")))

    whole = F.transform(spellings(F.col("name")), lambda s: entry(s, "名", norm_name(F.col("name")), 0))
    aliases = F.flatten(F.transform("aliases", lambda a: F.transform(spellings(a), lambda s: entry(s, "別", norm_name(a), 1))))
    sur = F.when(splits, F.array(entry(F.element_at(parts, 1), "姓", F.element_at(parts, 1), 2))).otherwise(F.array())
    given = F.when(splits, F.array(entry(F.element_at(parts, -1), "下", norm_name(F.col("name")), 3))).otherwise(F.array())
    kana = F.filter(F.concat(F.array("reading"), F.filter("aliases", lambda a: a.rlike(r"^[\p{IsHiragana}\p{IsKatakana}ー 　]+$"))), lambda r: F.length(r) >= 2)
    readings = F.flatten(F.transform(kana, lambda r: F.transform(F.array_distinct(F.array(r, hiragana(r), katakana(r), norm_name(hiragana(r)), norm_name(katakana(r)))), lambda s: entry(s, "読", norm_name(r), 4, F.when(F.length(s) == 2, HOUSED)))))
    entries = rows.select("row_no", "prefix", "name", F.explode(F.concat(whole, aliases, sur, given, readings)).alias("e")).select("row_no", "prefix", "name", "e.*").filter("surface <> ''")
    first = W.partitionBy("surface").orderBy("rank", "row_no")
    kept = entries.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return kept.select("surface", "space", "prefix", F.col("key").alias("orig"), norm_name(F.col("name")).alias("person"), "needs")


def merged(registry: DataFrame) -> DataFrame:
    """One row for each kind and name: the spelling with a space if there is one, all aliases in order."""
    by = registry.withColumn("norm", norm_name(F.col("name")))
    rows = by.groupBy("kind", "norm").agg(
        F.min("row_no").alias("row_no"),
        F.max_by("name", F.struct(F.col("name").rlike("[ 　]").cast("int"), -F.col("row_no"))).alias("name"),
        F.sort_array(F.collect_list(F.struct("row_no", "aliases"))).alias("all"),
        F.max("reading").alias("reading"), F.count("*").alias("n_rows"),
    )
    return rows.select("row_no", "kind", "name", F.array_distinct(F.flatten(F.transform("all", lambda a: F.coalesce(a["aliases"], F.array().cast("array<string>"))))).alias("aliases"), "reading", "n_rows")


def duplicates(registry: DataFrame) -> DataFrame:
    return merged(registry).filter("n_rows > 1")


def masked_owners(words: DataFrame, registry: DataFrame, most: int = 8) -> DataFrame:
    """Owners of partly hidden words (`word`): names, parts and aliases of the same length that agree in
    every character that is shown. Words and spellings meet by length and one shown character and its
    place, so nothing is crossed; full names rank before parts."""
    glyph = MASK_GLYPHS[0]
    key = mask_key(norm_name(F.col("word")))
    asked = words.select("word", key.alias("key")).distinct().filter(F.col("key").contains(glyph) & (F.translate("key", glyph, "") != ""))
    at = F.length(F.regexp_extract("key", f"^{glyph}*", 0)) + 1
    asked = asked.withColumn("at", at.cast("int")).withColumn("shown", F.substring("key", F.col("at"), F.lit(1))).withColumn("len", F.length("key"))
    spelt = dictionary(registry).filter(F.col("space").isin("名", "別", "姓", "下")).select(norm_name(F.col("surface")).alias("surface"), "person", F.when(F.col("space") == "名", 0).when(F.col("space") == "別", 1).otherwise(2).alias("rank")).distinct()
    spelt = spelt.withColumn("len", F.length("surface")).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("len")))).withColumn("shown", F.substring("surface", F.col("at"), F.lit(1)))
    fits = F.forall(F.zip_with(F.split("key", ""), F.split("surface", ""), lambda a, b: (a == glyph) | (a == b)), lambda x: x)
    met = asked.join(spelt, ["len", "at", "shown"]).filter(fits).groupBy("word", "person").agg(F.min("rank").alias("rank"))
    ranked = met.withColumn("place", F.row_number().over(W.partitionBy("word").orderBy("rank", "person")))
    return ranked.filter(F.col("place") <= most).select("word", "person", "rank", "place")


def near_names(words: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Words (`word`) that differ from a surface of the same length in exactly one character: word,
    surface, at. Both sides meet by a hash of the word with one place blanked, and are compared then. At most a
    word for each character there is has the same key, so no key is hot; a pair meets at one place only."""
    def rest(c: str, i: Column) -> tuple[Column, Column]:
        return F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))

    def blanked(c: str) -> Column:
        return F.posexplode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.xxhash64(i, F.length(c), *rest(c, i))))

    a = words.select("word").distinct().filter(F.length("word") >= 2).select("word", blanked("word").alias("at", "key"))
    b = surfaces.select("surface").distinct().filter(F.length("surface") >= 2).select("surface", blanked("surface").alias("_at", "key"))
    same = [x == y for x, y in zip(rest("word", F.col("at") + 1), rest("surface", F.col("at") + 1), strict=True)]
    met = a.join(shuffled(b), "key").filter((F.col("word") != F.col("surface")) & (F.col("at") == F.col("_at")) & (F.length("word") == F.length("surface")) & same[0] & same[1])
    return met.select("word", "surface", "at")


def nearest_person(units: DataFrame, mentions: DataFrame, within: int = 3) -> DataFrame:
    """For each unit the person mentioned nearest to it in its document, at most `within` units away;
    at equal distance the later unit wins. mentions: doc_id, seq, person."""
    spread = mentions.select("doc_id", "person", F.col("seq").alias("m_seq"), F.explode(F.sequence(F.col("seq") - within, F.col("seq") + within)).alias("seq"))
    met = units.select("doc_id", "seq").join(shuffled(spread), ["doc_id", "seq"])
    best = F.min_by("person", F.struct(F.abs(F.col("m_seq") - F.col("seq")), -F.col("m_seq"), F.col("person")))
    return met.groupBy("doc_id", "seq").agg(best.alias("person"), F.min(F.abs(F.col("m_seq") - F.col("seq"))).alias("distance"))

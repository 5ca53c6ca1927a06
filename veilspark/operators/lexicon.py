"""Lexicons of words that aren't names: by longest ending, with optional suffixes, and by exact form.

A lexicon is a table (entry, kind). Different words are looked up once; a word has as many endings as it
has characters, at most as many as the longest entry, so no word is compared with all entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dimension_join, spread_join


def _entries(lexicon: DataFrame) -> DataFrame:
    """One row for each entry; of several kinds the least."""
    return lexicon.filter("entry <> ''").groupBy("entry").agg(F.min("kind").alias("kind"))


def longest_endings(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, ending, kind: for each different word that ends in an entry, or is one, the longest such entry.
    Null and empty words and entries are left out."""
    entries = _entries(lexicon)
    longest = entries.agg(F.max(F.length("entry"))).first()[0] or 0
    different = words.select("word").filter("word <> ''").distinct()
    ends = different.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("word"), F.lit(longest)))), lambda n: F.right("word", n))).alias("entry"))
    met = spread_join(ends, entries, ["entry"], F.col("word"))
    best = F.max(F.struct(F.length("entry").alias("n"), "entry", "kind"))
    return met.groupBy("word").agg(best.alias("b")).select("word", F.col("b.entry").alias("ending"), F.col("b.kind").alias("kind"))


def common_words(words: DataFrame, lexicon: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """word and kind of the different words that are an entry, or an entry followed by one of the suffixes
    (by the longest entry)."""
    entries = _entries(lexicon)
    cuts = F.array_compact(F.array(F.col("word"), *[F.when(F.col("word").endswith(s), F.left("word", F.length("word") - len(s))) for s in suffixes]))
    tried = words.select("word").filter("word <> ''").distinct().select("word", F.explode(F.array_distinct(cuts)).alias("entry"))
    met = spread_join(tried, entries, ["entry"], F.col("word"))
    return met.groupBy("word").agg(F.max_by("kind", F.struct(F.length("entry"), F.col("entry"))).alias("kind"))


def without_form_words(suspects: DataFrame, lexicon: DataFrame, registered: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Suspects (with `word`) but those whose word is of the lexicon; a registered word (`word`) stays."""
    form = common_words(suspects, lexicon, suffixes).select("word").join(registered.select("word").distinct(), "word", "left_anti")
    return dimension_join(suspects, form, "word", "left_anti")

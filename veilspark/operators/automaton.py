"""Words of a large dictionary in texts, by an automaton of a trie with failure links.

The dictionary is dealt into parts of at most PART words; each is built into an automaton, which a task runs
over its texts in Arrow batches: the work grows with the text and the findings, not with the dictionary, and
texts aren't shuffled. Only a part at a time passes the driver. All occurrences are found, overlapping ones and
those inside others too; `longest` then chooses, from the left, the longest that don't overlap.

Defined cases: null and empty texts have no findings; null and empty words are no words; words that repeat count
once. Other columns of the units are passed on but for `found`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import kept

#: Words of an automaton, so that it fits into a task's memory.
PART = 100_000
FOUND = "array<struct<st:int,en:int>>"
ARROW = pa.list_(pa.struct([("st", pa.int32()), ("en", pa.int32())]))
_BUILT: dict[int, object] = {}


def built(words: tuple[str, ...]):
    """The automaton of the words; a worker builds it once."""
    import ahocorasick

    key = hash(words)
    if key not in _BUILT:
        _BUILT.clear()
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, len(w))
        automaton.make_automaton()
        _BUILT[key] = automaton
    return _BUILT[key]


def occurrences(units: DataFrame, dictionary: DataFrame, text: str = "text", word: str = "word", part: int = PART) -> DataFrame:
    """units with found: all occurrences of the dictionary's words, by start and then end."""
    words = dictionary.select(F.col(word).alias("word")).filter("word <> ''").distinct()
    n = words.count()
    parts = -(-n // part)
    if parts > 1:
        words = kept(words, "words")
    rows = units.drop("found").withColumn("found", F.array().cast(FOUND))
    for k in range(parts):
        # A part has `part` words on average; its words alone reach the driver.
        own = tuple(sorted(r["word"] for r in words.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == k).collect()))

        def batches_of(batches: Iterator[pa.RecordBatch], own: tuple[str, ...] = own) -> Iterator[pa.RecordBatch]:
            automaton = built(own)
            for batch in batches:
                place, out = batch.schema.get_field_index("found"), []
                for t, before in zip(batch.column(text).to_pylist(), batch.column("found").to_pylist(), strict=True):
                    own_hits = [{"st": end + 1 - n, "en": end + 1} for end, n in automaton.iter(t or "")]
                    out.append(sorted(before + own_hits, key=lambda s: (s["st"], s["en"])))
                yield batch.set_column(place, "found", pa.array(out, ARROW))

        rows = rows.mapInArrow(batches_of, rows.schema)
    return rows


def longest(found: Column) -> Column:
    """Of the occurrences (by start and end) the leftmost, of these the longest, that don't overlap."""
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("struct<st:int,en:int>").alias("held"), F.array().cast(FOUND).alias("out"))

    def step(a: Column, s: Column) -> Column:
        longer = a["held"].isNotNull() & (s["st"] == a["held"]["st"])
        new = ~longer & (s["st"] >= a["at"])
        out = F.when(new & a["held"].isNotNull(), F.array_append(a["out"], a["held"])).otherwise(a["out"])
        take = longer | new
        return F.struct(F.when(take, s["en"]).otherwise(a["at"]).alias("at"), F.when(take, s).otherwise(a["held"]).alias("held"), out.alias("out"))

    return F.aggregate(found, start, step, lambda a: F.when(a["held"].isNotNull(), F.array_append(a["out"], a["held"])).otherwise(a["out"]))

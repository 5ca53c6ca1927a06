"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A document is cut into paragraphs, at line breaks and after a word that, with the one before it, a hash
picks, so a cut depends on the text around it only, in any script; where a script has no spaces, its
characters are the words. Each paragraph's 64-bit digest goes into one cell
of each of three tables; a cell holds a count, the xor of its digests and the xor of their checks.
Sketches subtract cell by cell. What two versions don't share is peeled from the difference: a cell
with one digest gives it away, taking it out of its other cells gives more. Where peeling sticks,
the digests are dealt by their next bits over four sketches and tried again, so a retry's sketches
are four times as large together; parts that stick again are dealt again.

Likeness is the number of shared digests over that of all, from what peeling recovers. All is
DataFrame functions; each document's sketch is made in its own row, and a retry costs in proportion
to the digests that it deals.

Defined cases: a null text is empty. A text without paragraphs has the sketch of none; two of these
are alike (1), one of them and another text are not (0). Repeated paragraphs count once. Every row has
its result: rows that share a doc_id follow each other by a hash of their texts, equal rows one by one.
A null doc_id comes last. A lone document is its own next. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, ranked

#: Words are what stands between spaces; those of more characters than this are cut further, after white
#: space and after each character of a script without spaces.
LONG = 40
WORD_END = r"(?<=\s)(?=\S)|(?<=[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\uA4CF\uF900-\uFAFF])"
#: One pair of words in how many ends a paragraph.
PICKED = 32  # a power of two
TABLES, CELLS = 3, 8
#: Rounds of peeling, and retries before what is left of a part is compared directly.
ROUNDS, RETRIES = 8, 14
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)
CELL = "struct<n:int,digest:bigint,check:bigint>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), evaluating value once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def digests(text: Column) -> Column:
    def cut(words: Column) -> Column:
        def ends(i: Column) -> Column:
            pair = F.xxhash64(F.get(words, i - 1), F.get(words, i))
            return (pair.bitwiseAND(F.lit(PICKED - 1)) == 0) | F.contains(F.get(words, i), F.lit("\n")) | (i == F.size(words) - 1)

        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), ends)
        return let(places, lambda at: F.array_distinct(F.transform(at, lambda e, j: let(F.coalesce(F.get(at, j - 1), F.lit(-1)), lambda last: F.xxhash64(F.slice(words, last + 2, e - last))))))

    def worded(plain: Column) -> Column:
        parts = F.flatten(F.transform(plain, lambda w: F.when(F.length(w) > LONG, F.split(w, WORD_END, -1)).otherwise(F.array(w))))
        return F.when(F.exists(plain, lambda w: F.length(w) > LONG), parts).otherwise(plain)

    return F.when(text.rlike(r"\S"), let(let(F.split(text, " ", -1), worded), cut)).otherwise(F.array().cast("array<bigint>"))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(1))


def _marked(digest: Column, n: Column) -> Column:
    """A digest with its sign, its check and its cell in each table."""
    mixed = F.xxhash64(digest, F.lit(2))
    cells = [(F.shiftrightunsigned(mixed, 8 * t).bitwiseAND(F.lit(CELLS - 1)) + t * CELLS).cast("int") for t in range(TABLES)]
    return F.struct(n.cast("int").alias("n"), digest.alias("digest"), _check(digest).alias("check"), F.array(*cells).alias("cells"))


def _taken(cell: Column, marked: Column, i: Column, sign: int) -> Column:
    """The cell with the digests that belong to it added or taken out."""
    own = F.filter(marked, lambda m: F.get(m["cells"], F.floor(i / CELLS).cast("int")) == i)
    return F.aggregate(own, cell, lambda c, m: F.struct((c["n"] + sign * m["n"]).alias("n"), c["digest"].bitwiseXOR(m["digest"]).alias("digest"), c["check"].bitwiseXOR(m["check"]).alias("check")).cast(CELL))


def sketch(found: Column) -> Column:
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("digest"), F.lit(0).alias("check")).cast(CELL)
    return let(F.transform(found, lambda d: _marked(d, F.lit(1))), lambda marked: F.transform(F.sequence(F.lit(0), F.lit(TABLES * CELLS - 1)), lambda i: _taken(none, marked, i, 1)))


def shown(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"]), 4, "0"), F.lpad(F.hex(c["digest"]), 16, "0"), F.lpad(F.hex(c["check"]), 16, "0"))), "")


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["digest"].bitwiseXOR(y["digest"]).alias("digest"), x["check"].bitwiseXOR(y["check"]).alias("check")).cast(CELL))


def peeled(cells: Column) -> Column:
    """struct<done, a, b>: whether all came out, and the digests of either side."""

    def pure(cells: Column) -> Column:
        single = F.filter(cells, lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["digest"])))
        return F.array_distinct(F.transform(single, lambda c: _marked(c["digest"], c["n"])))

    def step(state: Column, _: Column) -> Column:
        return let(pure(state["cells"]), lambda out: F.when(F.size(out) == 0, state).otherwise(F.struct(
            F.transform(state["cells"], lambda c, i: _taken(c, out, i, -1)).alias("cells"),
            F.concat(state["a"], F.transform(F.filter(out, lambda m: m["n"] == 1), lambda m: m["digest"])).alias("a"),
            F.concat(state["b"], F.transform(F.filter(out, lambda m: m["n"] == -1), lambda m: m["digest"])).alias("b"),
        )))

    none = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), none.alias("a"), none.alias("b"))
    empty = lambda cells: F.forall(cells, lambda c: (c["n"] == 0) & (c["digest"] == 0) & (c["check"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.struct(empty(s["cells"]).alias("done"), s["a"].alias("a"), s["b"].alias("b")))


def differing(pairs: DataFrame) -> DataFrame:
    """pairs: key, which, left, right (arrays of distinct digests). Returns key, which, only_left and
    only_right (numbers of recovered digests), summed over the parts that a pair was dealt into."""
    left, done = pairs, []
    for level in range(RETRIES + 1):
        tried = left.withColumn("out", peeled(difference(sketch(F.col("left")), sketch(F.col("right")))))
        if level == RETRIES:  # digests that agree in all these bits
            plain = F.struct(F.lit(True).alias("done"), F.array_except("left", "right").alias("a"), F.array_except("right", "left").alias("b"))
            tried = left.withColumn("out", plain)
        tried = kept(tried.select("key", "which", "out.done", F.size("out.a").alias("only_left"), F.size("out.b").alias("only_right"), *[F.when(~F.col("out.done"), F.col(c)).alias(c) for c in ("left", "right")]), "peeled")
        done.append(tried.filter("done").select("key", "which", "only_left", "only_right"))
        stuck = tried.filter("not done")
        if level == RETRIES or stuck.isEmpty():
            break

        def dealt(c: str, part: Column, level: int = level) -> Column:
            return F.filter(c, lambda d: F.shiftrightunsigned(d, 2 * level).bitwiseAND(F.lit(3)) == part)

        parts = stuck.withColumn("part", F.explode(F.array(*map(F.lit, range(4)))))
        left = parts.select("key", "which", dealt("left", F.col("part")).alias("left"), dealt("right", F.col("part")).alias("right"))
    return reduce(DataFrame.unionAll, done).groupBy("key", "which").agg(F.sum("only_left").alias("only_left"), F.sum("only_right").alias("only_right"))


def edited(docs: DataFrame) -> DataFrame:
    """key, times, doc_id, n_chars, edited_sha256 and the digests of the text, the edited text and the
    next document's text, for each row of docs; equal rows that also have the same next are one row here,
    with their number as `times`. A text is dealt once, and half of it at most goes on to the document before."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = kept(rows.select("id", "h", F.length("text").alias("n")), "lengths")
    groups = order.groupBy("id", "h").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    if not groups.filter("rows > 1").isEmpty():
        rows = rows.dropDuplicates(["id", "h"])
    total = groups.count()
    # The id that stands for null comes last.
    order = kept(ranked(groups, [F.col("id") == NO_ID, F.col("id"), F.col("h")], "place"), "order")
    before = order.select(F.col("id").alias("p_id"), F.col("h").alias("p_h"), F.col("n").alias("p_n"), F.pmod(F.col("place") + 1, F.lit(max(1, total))).alias("place"))
    order = order.drop("n").join(before, "place")
    # Both uses of `own` below need the same columns, so that they share one exchange of the texts.
    own = rows.withColumn("own", digests(F.col("text"))).join(order, ["id", "h"]).select("id", "h", "text", "own", "place", "rows", "p_id", "p_h", "p_n")
    given = own.select(F.col("p_id").alias("id"), F.col("p_h").alias("h"), F.substring("text", F.lit(1), F.floor(F.col("p_n") / 2).cast("int")).alias("head"), F.col("own").alias("next"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    # Of equal rows all but the last are followed by their own text.
    nexts = F.array(F.struct(F.lit(0).alias("self"), F.lit(1).cast("long").alias("times"), "head", "next"), F.struct(F.lit(1).alias("self"), (F.col("rows") - 1).alias("times"), F.substring("text", F.lit(1), half).alias("head"), F.col("own").alias("next")))
    met = own.join(given, ["id", "h"]).select("id", "place", "text", "own", F.explode(F.when(F.col("rows") > 1, nexts).otherwise(F.slice(nexts, 1, 1))).alias("x"))
    text = F.concat(F.substring("text", F.lit(1), n - half), F.col("x.head"))
    met = met.select((2 * F.col("place") + F.col("x.self")).alias("key"), "x.times", F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), n.cast("long").alias("n_chars"), text.alias("edited"), "own", "x.next")
    return met.select("key", "times", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", digests(F.col("edited")).alias("edited"), "next")


def likeness(only_left: Column, only_right: Column, size: Column) -> Column:
    every = size + only_right
    return F.when(every == 0, 1.0).otherwise((size - only_left) / every)


def compared(docs: DataFrame) -> DataFrame:
    rows = kept(edited(docs), "edited")
    pairs = rows.select("key", F.explode(F.array(*[F.struct(F.lit(w).alias("which"), F.col("own").alias("left"), F.col(w).alias("right")) for w in ("edited", "next")])).alias("p")).select("key", "p.*")
    counts = differing(pairs)
    two = counts.groupBy("key").agg(*[F.max(F.when(F.col("which") == w, F.col(c))).alias(f"{w}_{c}") for w in ("edited", "next") for c in ("only_left", "only_right")])
    size = F.size("own")
    every = rows.join(two, "key").withColumn("one", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return every.select(
        "doc_id", "n_chars", "edited_sha256", shown(sketch(F.col("own"))).alias("fingerprint"), shown(sketch(F.col("edited"))).alias("edited_fingerprint"),
        *[likeness(F.col(f"{w}_only_left"), F.col(f"{w}_only_right"), size).alias(f"near_{w}") for w in ("edited", "next")],
    )

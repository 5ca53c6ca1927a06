"""The codebook: surrogate codes that are given once and kept for ever.

Rows: key (`namespace|prefix|value`), prefix, n, code, orig, restore, is_name, is_numeric. Codes are
numbered within their prefix in the order of first appearance; the book only grows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import CODE, CUT, TOKEN, let, located
from ..functions.text import norm_name, sanitize_prefix
from ..storage import dimension_join, hot_keys, kept, ranked_within, salted_join, shuffled, skewed_join, small
from .spans import replaced

SCHEMA = "key string, prefix string, n long, code string, orig string, restore string, is_name boolean, is_numeric boolean"
#: Namespaces whose codes stand for names, and the one of numbers.
NAME_SPACES, NUMBER_SPACE = ("名", "姓", "下", "別", "読"), "数"
ORDER = ["doc_id", "part_no", "seq", "st"]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def key_of(space: Column, prefix: Column, orig: Column) -> Column:
    return F.concat_ws("|", space, sanitize_prefix(prefix), orig)


def code_of(prefix: Column, n: Column) -> Column:
    return F.concat(F.lit("【"), prefix, F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")), F.lit("】"))


def allocate(spans: DataFrame, book: DataFrame) -> DataFrame:
    """Rows to append to book for the keys of spans (space, kind, orig and ORDER) that it lacks."""
    keyed = spans.select(key_of(F.col("space"), F.col("kind"), F.col("orig")).alias("key"), "space", sanitize_prefix(F.col("kind")).alias("prefix"), "orig", F.struct(*ORDER).alias("at"))
    new = keyed.groupBy("key", "space", "prefix", "orig").agg(F.min("at").alias("at")).join(book.select("key"), "key", "left_anti")
    most = book.groupBy("prefix").agg(F.max("n").alias("most"))
    numbered = ranked_within(new.select("key", "space", "prefix", "orig", "at"), "prefix", ["at", "key"], "rank").join(most, "prefix", "left")
    n = F.col("rank") + F.coalesce("most", F.lit(0))
    is_name = F.col("space").isin(*NAME_SPACES)
    spaceless = (F.col("space") == "名") | ((F.col("space") == "文") & F.col("prefix").contains("名"))
    return numbered.select("key", "prefix", n.alias("n"), code_of(F.col("prefix"), n).alias("code"), "orig", F.when(spaceless, norm_name(F.col("orig"))).otherwise(F.col("orig")).alias("restore"), is_name.alias("is_name"), (F.col("space") == NUMBER_SPACE).alias("is_numeric"))


def allocate_suffixed(rows: DataFrame, book: DataFrame, suffix: str) -> DataFrame:
    """Rows to append for values that hang on a base code (base_code, key, orig and `at`): alias,
    reading, other spelling or continuation codes `base + suffix + number`, next free number first."""
    new = rows.groupBy("base_code", "key", "orig").agg(F.min("at").alias("at")).join(book.select("key"), "key", "left_anti")
    stem = F.concat(F.rtrim(F.col("base_code"), F.lit("】")), F.lit(suffix))
    used = book.filter(F.col("code").contains(suffix)).select(F.regexp_extract("code", f"^(.*{suffix})[0-9]*】$", 1).alias("stem"), F.regexp_extract("code", f"{suffix}([0-9]+)】$", 1).try_cast("long").alias("m")).groupBy("stem").agg(F.max("m").alias("most"))
    numbered = ranked_within(new.withColumn("stem", stem), "stem", ["at", "key"], "rank").join(used, "stem", "left")
    n = F.col("rank") + F.coalesce("most", F.lit(0))
    return numbered.select("key", F.col("stem").alias("prefix"), n.alias("n"), F.concat("stem", n.cast("string"), F.lit("】")).alias("code"), "orig", F.col("orig").alias("restore"), F.lit(suffix in ("の呼び名", "の読み")).alias("is_name"), F.lit(False).alias("is_numeric"))


def with_codes(spans: DataFrame, book: DataFrame) -> DataFrame:
    """spans with the code of each; a value that fills a third of all spans is dealt over many tasks."""
    keyed = spans.withColumn("key", key_of(F.col("space"), F.col("kind"), F.col("orig")))
    codes = book.select("key", "code")
    if small(codes):
        return keyed.join(F.broadcast(codes), "key")
    keyed = kept(keyed, "keyed")
    return skewed_join(keyed, codes, ["key"], F.struct(*ORDER), hot_keys(keyed, ["key"]))


def tokens_in(units: DataFrame, text: str = "text") -> DataFrame:
    """Codes in the texts of units: the unit's columns but the text, st and code."""
    found = units.filter(F.col(text).contains("【")).select(*[c for c in units.columns if c != text], F.explode(located(F.col(text), TOKEN)).alias("t"))
    return found.select("*", F.col("t.st").alias("st"), F.col("t.orig").alias("code")).drop("t")


def restore(units: DataFrame, book: DataFrame, text: str = "text", unit: tuple[str, ...] = ("doc_id", "part_no", "seq")) -> DataFrame:
    """units with the originals of known codes in `restored`, and the unknown codes in `unknown`. Units
    without a code aren't shuffled through the lookup."""
    known = book.select("code", F.col("restore").alias("orig")).dropDuplicates(["code"])
    looked = dimension_join(tokens_in(units.select(*unit, text), text), known, "code", "left")
    spans = looked.groupBy(*unit).agg(
        F.array_sort(F.collect_list(F.when(F.col("orig").isNotNull(), F.struct("st", F.length("code").alias("len"), F.col("orig").alias("code"))))).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.col("orig").isNull() & F.col("code").rlike(f"^{CODE}$"), F.col("code")))).alias("unknown"),
    )
    # A text without a code is passed on; only the others meet their codes.
    coded = F.coalesce(F.col(text).contains("【"), F.lit(False))
    joined = units.filter(coded).join(spans, list(unit), "left")
    restored = F.when(F.col("spans").isNull(), F.col(text)).otherwise(replaced(F.col(text), F.col("spans")))
    none = F.array().cast("array<string>")
    out = joined.withColumn("restored", restored).withColumn("unknown", F.coalesce("unknown", none)).drop("spans")
    return out.unionByName(units.filter(~coded).withColumn("restored", F.col(text)).withColumn("unknown", none))


#: Characters that an original has for the gate to look for it.
KEY_CHARS = 6
#: Further lengths by which originals are looked up, so that few share what longer ones are looked up by.
LONG_KEYS = (8, 11, 16)
#: Of these every original of a shape has one at least.
SIGNS = "0-9０-９@"


def leftovers(units: DataFrame, book: DataFrame, text: str = "masked", registry: DataFrame | None = None, at_least: int = KEY_CHARS) -> DataFrame:
    """What still stands in the texts of units (doc_id, part_no, seq, text): their keys and orig, once each.

    That are mail addresses, names and addresses of the registry, and originals of shapes in the book that
    have `at_least` characters, wherever they stand, also inside other words; runs of one digit are
    forgiven. Originals meet the texts by a key, some of their characters with a digit or an at sign among them; only
    such runs of a text are rows. They are then looked for in full, in a text that is moved once."""
    from ..functions.patterns import SHAPES, shape_spans
    from . import names

    unit = ["doc_id", "part_no", "seq"]
    rows = units.select(*unit, F.col(text).alias("text"))
    mail = next(s for s in SHAPES if s.guard == "@")
    found = [rows.filter(F.col("text").contains("@")).select(*unit, F.explode(shape_spans(F.col("text"), mail)).alias("s")).select(*unit, "s.orig")]
    if registry is not None:
        spans = names.find_spans(rows, registry).filter(F.col("space") != "型")
        found.append(spans.select(*unit, F.col("matched").alias("orig")))
    known = book.filter(F.col("key").startswith("型|") & (F.length("orig") >= at_least) & ~F.col("orig").rlike(r"^(\d)\1*$")).select("orig").distinct()
    lengths = sorted({at_least, *(n for n in LONG_KEYS if n > at_least)})
    n = reduce(lambda out, k: F.when(F.length("orig") >= k, k).otherwise(out), lengths[1:], F.lit(at_least))
    # The first characters of an original or, if its first sign stands behind them, those that end there.
    sign = F.length(F.regexp_extract("orig", f"^[^{SIGNS}]*", 0)) + 1
    known = known.select("orig", F.substring("orig", F.greatest(F.lit(1), sign + 1 - n), n).alias("gram"))
    with_shape = rows.filter(F.col("text").rlike(f"[{SIGNS}]"))
    around = f"[^{SIGNS}]{{{lengths[-1] - 1}}}"
    # Of long stretches without a sign only what a run with one can reach.
    cut = F.regexp_replace("text", F.lit(f"({around})[^{SIGNS}]+({around})"), F.lit(f"$1{CUT}$2"))
    runs = lambda t: F.concat(*[F.regexp_extract_all(t, F.lit(f"(?s)(?=[^{SIGNS}]{{0,{k - 1}}}[{SIGNS}])(?=(.{{{k}}}))"), F.lit(1)) for k in lengths])
    grams = with_shape.select(*unit, F.explode(F.array_distinct(let(cut, runs))).alias("gram"))
    met = grams.join(F.broadcast(known), "gram") if small(known) else salted_join(grams, known, ["gram"], F.struct(*unit), salts=8, wide=True)
    near = with_shape.join(shuffled(met.groupBy(*unit).agg(F.collect_set("orig").alias("origs"))), unit)
    near = near.select(*unit, F.explode(F.filter("origs", lambda o: F.col("text").contains(o))).alias("orig"))
    found.append(near)
    return reduce(DataFrame.unionByName, found).distinct()

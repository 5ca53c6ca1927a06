"""Personal data: base shapes, and identifiers that bootstrapped contexts add to them.

Everything is DataFrame functions. Each text's matches are found in its own row. Mentions are runs of
tokens that hold a digit or an at sign, and quoted tokens. Their neighbouring words make patterns: the
word to the left, the two words to the left, the words on both sides. Patterns and values form a graph.
Its seeds, with score 1, are the base matches and long random-looking strings; values of a base shape
that fail its check, as numbers that aren't cards, are refused for good.

A pattern's confidence is the sum of its values' scores over the number of places where its rarest word
stands anywhere in the corpus, so "the _" says nothing however many seeds it meets, and `token = _` says
much. Patterns count that have `min_seeds` different seeds or accepted values and enough confidence. A
value's score is the noisy-or of its patterns; from `min_instance` on it is accepted, and supports
patterns in the next round. Rounds end when no value is added. Mentions of accepted values, and of random
strings in patterns that count, become spans of the kind `context`.

Defined cases: a null text counts as empty (no spans, the hash of an empty string). Rows with equal
doc_id are scanned each for itself. An empty table gives an empty result. Columns other than doc_id
and text are ignored. Spans count code points, the end is exclusive; base spans stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import small
from .common import hot_keys, kept, salted_join, skewed_join

#: Listing order of the kinds; `context` is what the method adds.
KINDS = ("email", "ip", "card", "phone", "context")
#: The shapes that the contract gives. Possessive loops keep long runs linear; a
#: look-behind starts a match at the head of a run (or where the last match ended) only.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A run of tokens that hold a digit, an at sign or a quotation mark.
MENTION = r"(?<!\S)[^\s0-9@\"]*+[0-9@\"]\S*+(?: [^\s0-9@\"]*+[0-9@\"]\S*+)*+"
#: What stands around a mention without being part of it.
OPENING, CLOSING = r"^[\"'(\[{<]*+", r"[\"'.,;:!?)\]}>]*+$"
#: A seed beside the base shapes: 20 letters and digits or more, mixed.
RANDOM = r"^(?=(?:[^0-9]*[0-9]){4})(?=(?:[^A-Za-z]*[A-Za-z]){4})[A-Za-z0-9_+/=-]{20,}$"
#: Only digits and their separators, too many to be a year or a count.
NUMERIC = r"^[+0-9][0-9 ().-]*$"
#: Matches whose places are added up one after the other, before the parts are.
CHUNK = 64
OCTETS = r"^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"

SPAN = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, f) -> Column:
    """f(value), evaluating value once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _located(text: Column, regex: str) -> Column:
    """Matches of regex as array<struct<start, end, value, before, after>>; before and after are the
    text between this match and its neighbours. Places are added up in parts and then over the parts, as
    appending to an array copies it."""
    gaps, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    pairs = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("g"), v.alias("v"))), F.slice(gaps, 2, F.size(found)), lambda p, n: F.struct(p["g"].alias("g"), p["v"].alias("v"), n.alias("n")))
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["g"])
        end = start + F.length(p["v"])
        one = F.struct(start.alias("start"), end.alias("end"), p["v"].alias("value"), p["g"].alias("before"), p["n"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def placed(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def add(acc: Column, part: Column) -> Column:
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    def moved(m: Column, by: Column) -> Column:
        return F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after"))

    def whole(parts: Column) -> Column:
        starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), add, lambda acc: acc["starts"])
        return F.flatten(F.zip_with(parts, starts, lambda part, by: F.transform(part["out"], lambda m: moved(m, by))))

    def cut(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda k: placed(F.slice(pairs, k * CHUNK + 1, F.lit(CHUNK))))
        return F.when(F.size(pairs) == 0, none).when(F.size(pairs) <= CHUNK, placed(pairs)["out"]).otherwise(let(chunks, whole))

    return let(pairs, cut)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card_ok(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(12, 19) & _luhn(digits)


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, by start and then by kind: array<struct<start, kind, end>>."""
    shapes = (
        (EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        (IP, text.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(OCTETS)),
        (CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){11}"), _card_ok),
        (PHONE, F.contains(text, F.lit("+")), lambda v: F.length(_digits(v)).between(9, 15)),
    )

    def spans(kind: int, regex: str, guard: Column, keep) -> Column:
        good = F.filter(_located(text, regex), lambda m: keep(m["value"]))
        return F.when(guard, F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))).otherwise(F.array().cast(SPAN))

    return F.array_sort(F.concat(*(spans(kind, *shape) for kind, shape in enumerate(shapes))))


def _mentions(text: Column) -> Column:
    """Identifier-like runs with the words around them."""
    white = "\t\n\x0b\f\r"

    def spaced(gap: Column) -> Column:
        return F.lower(F.trim(F.translate(gap, white, " " * len(white))))

    def pattern(m: Column) -> Column:
        lead, value = F.length(F.regexp_extract(m["value"], OPENING, 0)), F.regexp_replace(F.regexp_replace(m["value"], OPENING, ""), CLOSING, "")
        start = m["start"] + lead
        before, after = spaced(m["before"]), spaced(m["after"])
        left, left2, right = F.substring_index(before, " ", -1), F.regexp_replace(F.substring_index(before, " ", -2), " +", " "), F.substring_index(after, " ", 1)
        kinds = F.array(
            F.when(left != "", F.struct(F.concat(F.lit("1 "), left).alias("pattern"), F.array(left).alias("words"))),
            F.when(left2 != left, F.struct(F.concat(F.lit("2 "), left2).alias("pattern"), F.split(left2, " ").alias("words"))),
            F.when((left != "") & (right != ""), F.struct(F.concat(F.lit("3 "), left, F.lit(" _ "), right).alias("pattern"), F.array(left, right).alias("words"))),
        )
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), m["value"].rlike('^"[^"]{8,}"').alias("quoted"), F.array_compact(kinds).alias("patterns"))

    none = F.array().cast("array<struct<start:int,end:int,value:string,quoted:boolean,patterns:array<struct<pattern:string,words:array<string>>>>>")
    return F.when(text.rlike('[0-9@"]'), F.transform(_located(text, MENTION), pattern)).otherwise(none)


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def occurrences(docs: DataFrame, words: DataFrame) -> DataFrame:
    """word and n, how often it stands in the lower-cased texts of docs, for the words asked for."""
    every = docs.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
    few = small(words)
    if few:
        every = every.join(F.broadcast(words), "word", "left_semi")
    counts = every.groupBy("word").agg(F.count("*").alias("n"))
    return counts if few else counts.join(words, "word", "left_semi")


def bootstrap(edges: DataFrame, min_seeds: int = 3, min_pattern: float = 0.3, min_instance: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """Values that the graph accepts, and the patterns that count. edges: pattern, n (places of its rarest
    word), value, seed and refused, one row for a pair.

    Scores are rounded, so that the order of sums decides nothing.
    """
    hot = hot_keys(edges, ["pattern"])
    state = kept(edges.filter("seed = 1").select("value").distinct(), "accepted")
    known = state.count()
    # A value that was accepted stays, so this ends.
    while True:
        support = salted_join(edges, state, ["value"], F.col("pattern"), salts=4)
        patterns = support.groupBy("pattern").agg((F.count("*") / (F.first("n") + 1)).alias("confidence"), F.count("*").alias("support"))
        patterns = kept(patterns.filter((F.col("support") >= min_seeds) & (F.col("confidence") >= min_pattern)).select("pattern", F.least(F.round("confidence", 9), F.lit(0.999999)).alias("confidence")), "patterns")
        reached = skewed_join(edges.filter("seed = 0 and not refused").select("pattern", "value"), patterns, ["pattern"], F.col("value"), hot)
        values = reached.groupBy("value").agg(F.round(1 - F.exp(F.sum(F.log1p(-F.col("confidence")))), 9).alias("found"))
        state = kept(values.filter(F.col("found") >= min_instance).select("value").unionByName(state).distinct(), "accepted")
        now = state.count()
        if now == known:
            break
        known = now
    return state, patterns


def find_personal_data(docs: DataFrame, min_seeds: int = 3, min_pattern: float = 0.3, min_instance: float = 0.4) -> DataFrame:
    """One row for each row of docs: doc_id, base and spans (array<struct<start, kind, end>>, kind
    counting in KINDS)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    read = texts.select("doc_id", F.xxhash64("text").alias("h"), base_spans(F.col("text")).alias("base"), _mentions(F.col("text")).alias("mentions"))
    read = kept(read, "pii")
    mentions = read.select("doc_id", "h", "base", F.explode("mentions").alias("m")).select("doc_id", "h", "m.*", F.exists("base", lambda s: (s["start"] < F.col("m.end")) & (s["end"] > F.col("m.start"))).alias("in_base"))
    # An identifier has at least six letters or digits, two of them digits, or is quoted.
    like = F.col("value").rlike(r"[0-9].*?[0-9]") & (F.length(F.regexp_replace("value", "[^A-Za-z0-9]", "")) >= 6) | F.col("quoted")
    mentions = mentions.filter(F.col("in_base") | like)
    seed = F.col("in_base") | F.col("value").rlike(RANDOM)
    mentions = mentions.withColumn("seed", seed.cast("int")).withColumn("refused", ~seed & F.col("value").rlike(NUMERIC))
    edges = mentions.select(F.explode("patterns").alias("p"), "value", "seed", "refused").groupBy("p.pattern", "p.words", "value").agg(F.max("seed").alias("seed"), F.min("refused").alias("refused"))
    edges = kept(edges, "edges")
    # Only patterns of several values, not refused, can ever count.
    able = kept(edges.groupBy("pattern", "words").agg(F.count_if(~F.col("refused")).alias("able")).filter(F.col("able") >= min_seeds), "able")
    words = kept(able.select(F.explode("words").alias("word")).distinct(), "words")
    counts = kept(occurrences(texts, words), "occurrences")
    placed = salted_join(able.select("pattern", "able", F.explode("words").alias("word")), counts, ["word"], F.col("pattern"), salts=8)
    placed = placed.groupBy("pattern", "able").agg(F.min("n").alias("n")).withColumn("n", F.greatest("n", "able"))
    placed = kept(placed.filter(F.col("able") >= min_pattern * (F.col("n") + 1)).select("pattern", "n"), "able-patterns")
    edges = kept(skewed_join(edges.drop("words"), placed, ["pattern"], F.col("value"), hot_keys(edges, ["pattern"])), "edges")
    accepted, patterns = bootstrap(edges, min_seeds, min_pattern, min_instance)
    # Of seeds that aren't base spans those count that stand in a pattern that counts.
    counted = salted_join(edges.filter("not refused").select("pattern", "value"), accepted, ["value"], F.col("pattern"), salts=4)
    counted = skewed_join(counted, patterns.select("pattern"), ["pattern"], F.col("value"), hot_keys(edges, ["pattern"])).select("value").distinct()
    added = salted_join(mentions.filter("not in_base").select("doc_id", "h", "start", "end", "value"), counted, ["value"], F.struct("doc_id", "start"), salts=16)
    added = added.groupBy(F.col("doc_id").alias("a_id"), F.col("h").alias("a_h")).agg(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")).alias("added"))
    both = read.select("doc_id", "h", "base").join(added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("h") == F.col("a_h")), "left")
    return both.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN)))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans for each kind, the hash of the base spans, and all spans as text."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(count, range(4)), F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_context"), F.size("spans").cast("long").alias("n_spans"))

"""Dictionary match: registered names and addresses as spans, with the codes they stand for."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import address_lumps
from ..functions.patterns import SPAN, candidates, let, pieces
from ..storage import kept, salted_join, small, spread_join
from . import codebook
from .mask import FOUND, UNIT, Masked, apply_found
from .registry import FOLLOWS, addresses, dictionary
from .spans import fold

#: Surfaces up to which the dictionary becomes one expression; beyond, texts and surfaces are joined.
EXPRESSION_SURFACES = 3000
NAME, ADDRESS = "氏名", "住所"


def _span(st: Column, orig: Column, prio: Column, kind: str) -> Column:
    return F.struct(st.cast("int").alias("st"), F.length(orig).alias("len"), prio.alias("prio"), F.lit(kind).alias("kind"), orig.alias("orig"))


def _script_ok(before: Column, surface: Column, after: Column) -> Column:
    """Kana names don't start or end inside a run of their own script."""
    hira, kata = r"^[\p{IsHiragana}ー]+$", r"^[\p{IsKatakana}ー]+$"
    in_hira = surface.rlike(hira) & (before.rlike(r"^[\p{IsHiragana}]$"))
    in_kata = surface.rlike(kata) & (before.rlike(r"^[\p{IsKatakana}ー]$") | after.rlike(r"^[\p{IsKatakana}]"))
    return ~(in_hira | in_kata)


def _around(text: Column, st: Column, surface: Column) -> tuple[Column, Column]:
    """The character before a surface and the four after it."""
    return F.substring(text, st, F.when(st > 0, 1).otherwise(0)), F.substring(text, st + F.length(surface) + 1, F.lit(4))


def _ok(before: Column, surface: Column, after: Column, needs: Column) -> Column:
    follows = F.lit(True)
    for need, regex in FOLLOWS.items():
        follows = F.when(needs == need, after.rlike(regex)).otherwise(follows)
    return follows & _script_ok(before, surface, after)


def _priority(needs: Column) -> Column:
    """Surfaces that need nothing after them come before those that do."""
    rank = F.lit(1)
    for i, need in enumerate(FOLLOWS, 2):
        rank = F.when(needs == need, i).otherwise(rank)
    return rank


def _everywhere(text: Column, words: list[str]) -> Column:
    """All places of the words, which are of one length, also where they overlap: array<struct<st, orig>>."""
    ahead = "(?=(" + "|".join(map(re.escape, words)) + "))"
    none = F.array().cast("array<struct<st:int,orig:string>>")

    def step(acc: Column, p: Column) -> Column:
        return F.struct((acc["at"] + F.length(p["piece"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(p["piece"])).alias("st"), p["v"].alias("orig")))).alias("out"))

    def placed(found: Column) -> Column:
        pairs = F.zip_with(F.slice(pieces(text, ahead), 1, F.size(found)), found, lambda p, v: F.struct(p.alias("piece"), v.alias("v")))
        return F.when(F.size(found) == 0, none).otherwise(F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"]))

    return let(F.regexp_extract_all(text, F.lit(ahead), F.lit(1)), placed)


def name_candidates(units: DataFrame, entries: DataFrame, expression_surfaces: int = EXPRESSION_SURFACES) -> DataFrame:
    """units with `names`, the spans of all dictionary surfaces at all places where their rules hold, also
    overlapping ones. A dictionary of at most expression_surfaces becomes expressions, a larger one is
    joined; the spans are the same."""
    text = F.col("text")
    if small(entries, expression_surfaces):
        # The size is checked: at most expression_surfaces short rows reach the driver.
        groups: dict[tuple[str, int], list[str]] = {}
        for r in entries.select("surface", "needs").collect():
            groups.setdefault((r["needs"], len(r["surface"])), []).append(r["surface"])
        parts = [F.transform(F.filter(_everywhere(text, sorted(words)), _keep(text, need)), _as_span(need)) for (need, _), words in sorted(groups.items())]
        return units.withColumn("names", F.concat(*parts).cast(SPAN) if parts else F.array().cast(SPAN))
    # One row for each length of a surface, so as many as the longest has characters.
    lengths = [r[0] for r in entries.select(F.length("surface").alias("n")).distinct().orderBy("n").collect()]
    places = units.filter("text <> ''").select(*UNIT, "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("st"))
    grams = places.select(*UNIT, "text", "st", F.explode(F.array(*[F.substring("text", F.col("st") + 1, F.lit(n)) for n in lengths])).alias("surface")).filter(F.col("st") + F.length("surface") <= F.length("text"))
    before, after = _around(text, F.col("st"), F.col("surface"))
    # Texts stay where they are: a place goes on with its surface and the characters around it.
    grams = grams.select(*UNIT, "st", "surface", before.alias("before"), after.alias("after")).dropDuplicates([*UNIT, "st", "surface"])
    met = salted_join(grams, entries.select("surface", "needs"), ["surface"], F.struct(*UNIT, "st"), salts=8).filter(_ok(F.col("before"), F.col("surface"), F.col("after"), F.col("needs")))
    spans = met.groupBy(*UNIT).agg(F.collect_list(_span(F.col("st"), F.col("surface"), _priority(F.col("needs")), NAME)).alias("names"))
    return units.join(spans, list(UNIT), "left").withColumn("names", F.coalesce("names", F.array().cast(SPAN)))


def _keep(text: Column, need: str):
    def keep(m: Column) -> Column:
        before, after = _around(text, m["st"], m["orig"])
        return _ok(before, m["orig"], after, F.lit(need))

    return keep


def _as_span(need: str):
    return lambda m: _span(m["st"], m["orig"], _priority(F.lit(need)), NAME)


def _with_lumps(units: DataFrame, cores: DataFrame, expression_surfaces: int) -> DataFrame:
    """units with `lumps`, the spans of registered addresses. Few registered addresses are tested in the row;
    of many, only texts that hold an address at all are joined."""
    text, kind = F.col("text"), "array<struct<st:int,len:int,core:string>>"
    lumps, none = address_lumps(text).cast(kind), F.array().cast(kind)
    if small(cores, expression_surfaces):
        # The size is checked: at most expression_surfaces short rows reach the driver.
        known = [r[0] for r in cores.select("core").filter("core IS NOT NULL").distinct().collect()]
        return units.withColumn("lumps", F.filter(lumps, lambda l: l["core"].isin(*known)) if known else none)
    found = units.select(*UNIT, F.explode(lumps).alias("l")).select(*UNIT, "l.*")
    found = spread_join(found, cores.select("core").distinct(), ["core"], F.struct(*UNIT, "st"))
    found = found.groupBy(*UNIT).agg(F.collect_list(F.struct("st", "len", "core")).alias("lumps"))
    any_ = F.coalesce(F.size(lumps) > 0, F.lit(False))
    joined = units.filter(any_).join(found, list(UNIT), "left").withColumn("lumps", F.coalesce("lumps", none))
    return joined.unionByName(units.filter(~any_).withColumn("lumps", none))


def with_spans(units: DataFrame, registry: DataFrame) -> DataFrame:
    """units with FOUND: the accepted spans of names, registered addresses and shapes."""
    both = _with_lumps(name_candidates(units, dictionary(registry), EXPRESSION_SURFACES), addresses(registry), EXPRESSION_SURFACES)
    address = F.transform("lumps", lambda s: F.struct(s["st"].alias("st"), s["len"].alias("len"), F.lit(0).alias("prio"), F.lit(ADDRESS).alias("kind"), s["core"].alias("orig")))
    return both.withColumn(FOUND, fold(F.concat(address.cast(SPAN), F.col("names"), candidates(F.col("text"))), F.col("text"))).drop("names", "lumps")


def spans_of(found: DataFrame, registry: DataFrame) -> DataFrame:
    """The spans in FOUND with what the registry says of them: UNIT, st, len, kind, orig, space, person, matched."""
    spans = found.select(*UNIT, F.explode(FOUND).alias("s")).select(*UNIT, "s.st", "s.len", "s.kind", "s.orig")
    known = dictionary(registry).select(F.col("surface").alias("orig"), F.lit(NAME).alias("kind"), "space", "prefix", F.col("orig").alias("value"), "person")
    met = spread_join(spans, known, ["orig", "kind"], F.struct(*UNIT, "st"), "left")
    return met.select(*UNIT, "st", "len", F.when(F.col("space") == "姓", "姓").otherwise(F.coalesce("prefix", "kind")).alias("kind"), F.coalesce("value", "orig").alias("orig"), F.coalesce("space", F.when(F.col("kind") == ADDRESS, "住").otherwise("型")).alias("space"), "person", F.col("orig").alias("matched"))


def find_spans(units: DataFrame, registry: DataFrame) -> DataFrame:
    """Accepted spans of names, registered addresses and shapes: UNIT, st, len, kind, orig, space."""
    return spans_of(with_spans(units, registry), registry)


def mask(units: DataFrame, registry: DataFrame, book: DataFrame) -> Masked:
    """Mask names, registered addresses and shapes. Given names, aliases and readings hang on the code
    of their person, which is allocated first."""
    found = kept(with_spans(units, registry), "found")
    spans = kept(spans_of(found, registry), "spans")
    hanging = {"下": "の名", "別": "の呼び名", "読": "の読み"}
    base = spans.withColumn("orig", F.when(F.col("space").isin(*hanging), F.col("person")).otherwise(F.col("orig"))).withColumn("space", F.when(F.col("space").isin(*hanging), "名").otherwise(F.col("space")))
    delta = kept(codebook.allocate(base, book), "codebook")
    whole = book.unionByName(delta)
    for space, suffix in hanging.items():
        own = spans.filter(F.col("space") == space)
        person = whole.filter(F.col("key").startswith("名|")).select(F.col("key").alias("p_key"), F.col("code").alias("base_code"))
        own = own.withColumn("p_key", codebook.key_of(F.lit("名"), F.col("kind"), F.col("person")))
        own = spread_join(own, person, ["p_key"], F.struct(*codebook.ORDER))
        keyed = own.select("base_code", codebook.key_of(F.lit(space), F.col("kind"), F.col("orig")).alias("key"), "orig", F.struct(*codebook.ORDER).alias("at"))
        if space == "下":
            new = keyed.groupBy("base_code", "key", "orig").agg(F.min("at").alias("at")).join(whole.select("key"), "key", "left_anti")
            code = F.concat(F.rtrim(F.col("base_code"), F.lit("】")), F.lit(suffix), F.lit("】"))
            given = own.groupBy(codebook.key_of(F.lit(space), F.col("kind"), F.col("orig")).alias("key")).agg(F.min("matched").alias("matched"))
            more = new.join(given, "key").select("key", F.lit(suffix).alias("prefix"), F.lit(0).cast("long").alias("n"), code.alias("code"), "orig", F.col("matched").alias("restore"), F.lit(True).alias("is_name"), F.lit(False).alias("is_numeric"))
        else:
            more = codebook.allocate_suffixed(keyed, whole, suffix)
        delta, whole = delta.unionByName(more), whole.unionByName(more)
    return Masked(apply_found(found, codebook.with_codes(spans, whole)), spans, delta)

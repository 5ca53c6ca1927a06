"""Entities that are broken over units: fragments of adjacent units form sessions, in which an entity is found whole
and its pieces get a base code and continuation codes.

A unit goes on in the next one of its part if the text before the border can be the beginning of an entity and the text
behind it can be more of it (`Joint`). Runs of units that go on are a session; all others, which
are nearly all units, stand alone and are left to the search in single texts. An entity is found in the session's texts put together, and cut
again where a unit ends and at separators, which stay outside the codes.

Defined cases: null and empty texts are units in which nothing stands and nothing goes on; units whose seq isn't the
next number are not adjacent; a part's rows that share a seq are taken in order of their text. Spans that overlap are
resolved as everywhere. A piece of nothing but blanks has no code. Empty tables give empty results. A session is as long
as its units really go on one after another; a text of any length can be part of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import address
from ..functions.patterns import SPAN, let, located
from ..functions.text import addr_canon, addr_norm
from ..storage import kept, spread_join
from . import codebook
from .mask import UNIT
from .spans import fold

#: Characters on either side of a border that decide whether it is one.
AROUND = 40


@dataclass(frozen=True)
class Joint:
    """Whether a text goes on: what its end and the head of the next text must match."""

    end: str
    head: str


#: An address goes on behind a level, a town or a numeral, with a town, a lot, or a building or room.
ADDRESS_JOINT = Joint(
    rf"(?:{address.LEVEL}|{address.PREFECTURE}|(?:{address.SOLID}|{address.HIRAGANA}){{1,{address.TOWN_CHARS}}}|{address.DIGIT}|丁目|番地?|号|{address.HYPHEN})[ 　]*$",
    rf"^[ 　]*(?:(?:{address.SOLID}|{address.HIRAGANA}){{1,{address.PLACE_CHARS}}}(?:{address.LEVEL}|{address.DIGIT})|{address.DIGIT}|{address.HYPHEN}|[^\s【】]{{0,12}}(?:{address.BUILDING}))",
)
#: Between the pieces of an entity; they stay outside its codes.
SEPARATORS = r"[\n\r\t、，,／/|｜・]"
#: Headings that may be glued to an address.
HEADINGS = ("現住所", "住所地", "所在地", "住所")
CONTINUED = "の続き"


def sessions(units: DataFrame, joint: Joint) -> DataFrame:
    """UNIT, text and session (seq of its first unit), of units in sessions of two and more."""
    order = W.partitionBy("doc_id", "part_no").orderBy("seq", "text")
    rows = units.select(*UNIT, "text", F.right("text", F.lit(AROUND)).rlike(joint.end).alias("ends"), F.left("text", F.lit(AROUND)).rlike(joint.head).alias("heads"))
    joined = (F.lag("seq").over(order) == F.col("seq") - 1) & F.lag("ends").over(order) & F.col("heads")
    marked = rows.withColumn("joined", F.coalesce(joined, F.lit(False)))
    # The borders alone decide, so texts that stand alone leave here.
    both = marked.withColumn("goes", F.coalesce(F.lead("joined").over(order), F.lit(False))).filter("joined or goes")
    upto = W.partitionBy("doc_id", "part_no").orderBy("seq", "text").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("session", F.max(F.when(~F.col("joined"), F.col("seq"))).over(upto)).select(*UNIT, "text", "session")


def _cut(borders: Column, whole: Column, span: Column, separators: str) -> Column:
    """The pieces of a span of the whole text between its borders (places where units begin) and separators."""
    inner = F.filter(borders, lambda b: (b > span["st"]) & (b < span["st"] + span["len"]))
    starts = F.concat(F.array(span["st"]), inner)
    ends = F.concat(inner, F.array(span["st"] + span["len"]))

    def part(st: Column, en: Column) -> Column:
        text = F.substring(whole, st + 1, en - st)
        return F.transform(located(text, rf"(?:(?!{separators}).)+"), lambda m: _trimmed(m, st))

    return F.flatten(F.zip_with(starts, ends, part))


def _trimmed(m: Column, st: Column) -> Column:
    """A piece without blanks at its ends."""
    left = F.length(F.regexp_extract(m["orig"], r"^[\s　]+", 0))
    return F.struct((st + m["st"] + left).cast("int").alias("st"), F.regexp_replace(m["orig"], r"^[\s　]+|[\s　]+$", "").alias("orig"))


def pieces(units: DataFrame, joint: Joint, spans: Callable[[Column], Column], separators: str = SEPARATORS) -> DataFrame:
    """UNIT, st, len and orig of the pieces of entities in sessions, with entity (whole, as its pieces put together),
    first (seq and place of its first piece) and piece (from 0).

    spans: of a text, its entities as array<SPAN>."""
    found = sessions(units, joint)
    by = found.groupBy("doc_id", "part_no", "session").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("units"))
    lengths = F.transform("units", lambda u: F.length(u["text"]))
    begins = F.transform(F.sequence(F.lit(0), F.size("units") - 1), lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, n: a + n))
    rows = by.select("doc_id", "part_no", F.col("units.seq").alias("seqs"), F.array_join("units.text", "").alias("whole"), begins.alias("begins"))
    whole = F.col("whole")
    rows = rows.select("*", F.explode(fold(spans(whole), whole)).alias("s"))
    cut = F.filter(_cut(F.col("begins"), whole, F.col("s"), separators), lambda p: p["orig"] != "")
    rows = rows.select("doc_id", "part_no", "seqs", "begins", F.posexplode(cut).alias("piece", "p"), F.array_join(F.transform(cut, lambda p: p["orig"]), "").alias("entity"), F.col("s.st").alias("at"))
    unit = F.size(F.filter("begins", lambda b: b <= F.col("p.st")))
    here = lambda st: F.struct(F.element_at("seqs", F.size(F.filter("begins", lambda b: b <= st))).alias("seq"), (st - F.element_at("begins", F.size(F.filter("begins", lambda b: b <= st)))).alias("st"))
    return rows.select("doc_id", "part_no", F.element_at("seqs", unit).alias("seq"), (F.col("p.st") - F.element_at("begins", unit)).alias("st"), F.length("p.orig").alias("len"), F.col("p.orig").alias("orig"), "entity", here(F.col("at")).alias("first"), "piece")


def addresses(text: Column) -> Column:
    """Addresses with building, room and postal code, without a heading that is glued to them."""
    def span(lump: Column) -> Column:
        orig = F.substring(text, lump["st"] + 1, lump["len"])
        head = F.length(F.regexp_extract(orig, rf"^(?:{'|'.join(HEADINGS)})[:： 　]*(?=.*{address.LEVEL})", 0))
        return F.struct((lump["st"] + head).alias("st"), (lump["len"] - head).alias("len"), F.lit(0).alias("prio"), F.lit("住所").alias("kind"), F.substring(orig, head + 1, F.length(orig)).alias("orig"))

    return let(address.address_lumps(text), lambda lumps: F.transform(lumps, span)).cast(SPAN)


def address_pieces(units: DataFrame) -> DataFrame:
    """The pieces of addresses that are broken over units, with the canonical form of the whole in `entity`."""
    found = pieces(units, ADDRESS_JOINT, addresses)
    canon = addr_canon(F.col("entity"))
    return found.withColumn("entity", F.when(canon == "", addr_norm(F.col("entity"))).otherwise(canon))


def coded(found: DataFrame, book: DataFrame, kind: str = "住所", space: str = "住") -> tuple[DataFrame, DataFrame]:
    """The pieces with their codes, and the rows to append to book: an entity's first piece has the code of
    the entity, later ones continuation codes that hang on it, one for each different text."""
    found = kept(found, "pieces")
    first = found.filter("piece = 0").select(*UNIT, "st", F.lit(space).alias("space"), F.lit(kind).alias("kind"), F.col("entity").alias("orig"))
    key = codebook.key_of(F.lit(space), F.lit(kind), F.col("entity"))
    # What is put back is the first piece as it was written, not the whole.
    spelt = found.filter("piece = 0").groupBy(key.alias("key")).agg(F.min_by("orig", F.struct(*codebook.ORDER)).alias("spelt"))
    base = codebook.allocate(first, book).join(spelt, "key", "left").withColumn("orig", F.coalesce("spelt", "orig")).withColumn("restore", F.col("orig")).drop("spelt")
    base = kept(base, "pieces-base")
    whole = book.unionByName(base)
    codes = whole.select(F.col("key").alias("base_key"), F.col("code").alias("base_code"), F.col("restore").alias("base_text"))
    rows = spread_join(found.withColumn("base_key", key), codes, ["base_key"], F.struct(*codebook.ORDER))
    own = F.concat_ws("|", F.lit("続"), "base_code", "orig")
    # A first piece that is written otherwise than the base hangs on it too, or restoring would change it.
    hangs = (F.col("piece") > 0) | (F.col("orig") != F.col("base_text"))
    rows = rows.withColumn("key", F.when(hangs, own).otherwise(F.col("base_key")))
    more = codebook.allocate_suffixed(rows.filter(hangs).select("base_code", "key", "orig", F.struct(*codebook.ORDER).alias("at")), whole, CONTINUED)
    more = kept(more, "pieces-more")
    known = whole.unionByName(more).select("key", "code")
    out = spread_join(rows, known, ["key"], F.struct(*codebook.ORDER))
    return out.select(*UNIT, "st", "len", "orig", "entity", "first", "piece", "code"), base.unionByName(more)

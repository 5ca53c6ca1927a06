"""Shapes of identifiers, and the spans of their matches in a text.

An expression only proposes; what a match means is decided from its numbers and from what stands around
it: a date is old by its era or year, a number is an age beside a label, a row of digits is a phone
number by its prefix and length. Offsets count characters from 0; ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ERAS, half_digits

DIGIT = "[0-9０-９]"
HYPHEN = "[-－‐−―ー]"
GAP = r"\s{0,2}"
#: Any code: 1 to 40 characters in brackets.
TOKEN = "【[^【】]{1,40}】"
#: A code as the codebook makes them, with what may follow the number.
CODE = r"【[^0-9０-９【】]+[0-9]{3,}(?:の(?:呼び名|読み|書き方|続き)[0-9]*|の名|の姓)?】"
ERA = "(?:" + "|".join(name for name, _, _ in ERAS) + "|[" + "".join(letter for _, letter, _ in ERAS) + r"]\.?)"
DATE = f"(?:{ERA}{GAP})?" + GAP.join((f"{DIGIT}{{1,4}}", "[年./／]", f"{DIGIT}{{1,2}}", "[月./／]", f"{DIGIT}{{1,2}}")) + f"(?:{GAP}日)?"
#: Eras that had ended before 1989; the last year of the calendar that counts as old.
OLD_ERAS = tuple(x for name, letter, start in ERAS if start < 1988 for x in (name, letter))
OLD_YEARS = (1800, 1965)
#: Digits of a phone number with its trunk prefix.
PHONE_DIGITS = (9, 11)
SPAN = "array<struct<st:int,len:int,prio:int,kind:string,orig:string>>"
#: Matches whose places are added up one after the other, before the parts are.
CHUNK = 64


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), evaluating value once."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: A sign that no text has, or few.
CUT = "\x1e"


def pieces(text: Column, regex: str) -> Column:
    """What stands between the matches of regex, one more than there are matches. Spark compiles what it splits at for each
    text, but not what it replaces, nor a single sign: matches become a sign, unless the text has it."""
    signed = F.split(F.regexp_replace(text, F.lit(regex), F.lit(CUT)), CUT, -1)
    own = F.split(text, regex, -1)
    # A split drops the empty piece before a match without width at the start.
    whole = F.concat(F.when(F.size(own) > F.size(F.regexp_extract_all(text, F.lit(regex), F.lit(0))), F.array().cast("array<string>")).otherwise(F.array(F.lit(""))), own)
    return F.when(text.contains(CUT), whole).otherwise(signed)


def matches(text: Column, regex: str) -> Column:
    """Matches of regex in order: array<struct<st, orig, before, after>>; before and after are the text
    between a match and its neighbours, or the neighbour where they touch. Places are added up in parts
    and then over the parts, as appending to an array copies it."""
    none = F.array().cast("array<struct<st:int,orig:string,before:string,after:string>>")

    def paired(gaps: Column, found: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            before, after = F.get(gaps, i), F.get(gaps, i + 1)
            touching = lambda gap, at: F.when(gap != "", gap).otherwise(F.coalesce(F.get(found, at), F.lit("")))
            return F.struct(v.alias("v"), F.length(before).alias("skip"), touching(before, i - 1).alias("before"), touching(after, i + 1).alias("after"))

        return F.transform(found, one)

    def step(acc: Column, p: Column) -> Column:
        st = acc["at"] + p["skip"]
        return F.struct((st + F.length(p["v"])).alias("at"), F.concat(acc["out"], F.array(F.struct(st.alias("st"), p["v"].alias("orig"), p["before"].alias("before"), p["after"].alias("after")))).alias("out"))

    def placed(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def moved(parts: Column) -> Column:
        add = lambda acc, part: F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
        starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), add, lambda acc: acc["starts"])
        shift = lambda m, by: F.struct((m["st"] + by).alias("st"), m["orig"].alias("orig"), m["before"].alias("before"), m["after"].alias("after"))
        return F.flatten(F.zip_with(parts, starts, lambda part, by: F.transform(part["out"], lambda m: shift(m, by))))

    def cut(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda k: placed(F.slice(pairs, k * CHUNK + 1, F.lit(CHUNK))))
        return F.when(F.size(pairs) <= CHUNK, placed(pairs)["out"]).otherwise(let(chunks, moved))

    def around(found: Column) -> Column:
        return F.when(F.size(found) == 0, none).otherwise(let(pieces(text, regex), lambda gaps: let(paired(gaps, found), cut)))

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), around)


def located(text: Column, regex: str) -> Column:
    """Matches of regex in order: array<struct<st, orig>>."""
    return F.transform(matches(text, regex), lambda m: F.struct(m["st"].alias("st"), m["orig"].alias("orig")))


def _birth(m: Column) -> Column:
    return m["before"].rlike(r"生年月日[：:]?\s{0,3}$") | m["after"].rlike(rf"^{GAP}生")


def _phone(m: Column) -> Column:
    """A trunk prefix, three groups, and as many digits as the numbering plan has."""
    digits = F.regexp_replace(m["orig"], f"{DIGIT}", "0")
    shape = digits.rlike(r"^0{2,5}[^0 　]0{1,4}[^0 　]0{3,4}$") | digits.rlike("^0{2,5}[ 　]0{2,4}[ 　]0{4}$")
    return shape & F.length(F.regexp_replace(digits, "[^0]", "")).between(*PHONE_DIGITS)


def _old(m: Column) -> Column:
    """An old era, or a year of the calendar up to the last old one. Years of four digits are compared as they are
    written: a cast that fails, as of no year at all, makes an error for each text."""
    plain = half_digits(m["orig"])
    return plain.rlike("^(?:" + "|".join(OLD_ERAS) + ")") | F.regexp_extract(plain, "^([0-9]{4})", 1).between(*map(str, OLD_YEARS))


def _age(m: Column) -> Column:
    enclosed = m["orig"].rlike("[歳才]$") & m["before"].rlike(rf"[(（]{GAP}$") & m["after"].rlike(rf"^{GAP}[)）]")
    return m["before"].rlike(rf"年齢[：:]?{GAP}$") | enclosed


@dataclass(frozen=True)
class Shape:
    """A kind of identifier. guard: what a text must hold to be searched at all. keep: whether a match
    counts. boundary: it may not touch a digit."""

    kind: str
    regex: str
    guard: str
    keep: Callable[[Column], Column] | None = None
    boundary: bool = False


#: In order of priority at equal places.
SHAPES = (
    Shape("生年月日", DATE, "生", _birth),
    Shape("メール", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,40}\.[A-Za-z]{2,}", "@"),
    Shape("電話", rf"[0０]{DIGIT}{{1,4}}(?:[-－‐−―ー()（） 　]{DIGIT}{{1,4}}){{2}}", f"[0０]{DIGIT}+[^0-9０-９]{DIGIT}", _phone, True),
    Shape("古い日付", DATE, f"{DIGIT}{GAP}[年./／]{GAP}{DIGIT}", _old, True),
    Shape("郵便番号", rf"(?:〒{GAP})?{DIGIT}{{3}}{HYPHEN}{DIGIT}{{4}}", f"{DIGIT}{HYPHEN}{DIGIT}", None, True),
    Shape("番号", f"{DIGIT}{{8,}}+", f"{DIGIT}{{8}}", None, True),
    Shape("年齢", rf"{DIGIT}{{1,3}}(?:\s?[歳才])?", "年齢|[歳才]", _age, True),
)
KINDS = tuple(s.kind for s in SHAPES)


def shape_spans(text: Column, shape: Shape, prio: int = 0) -> Column:
    """Spans of one shape, without spaces at their ends and, if the shape asks, off digits."""
    def counts(m: Column) -> Column:
        ok = F.lit(True) if shape.keep is None else shape.keep(m)
        return ok & ~m["before"].rlike(f"{DIGIT}$") & ~m["after"].rlike(f"^{DIGIT}") if shape.boundary else ok

    def span(m: Column) -> Column:
        left = F.length(m["orig"]) - F.length(F.ltrim(m["orig"]))
        orig = F.trim(m["orig"])
        return F.struct((m["st"] + left).alias("st"), F.length(orig).alias("len"), F.lit(prio).alias("prio"), F.lit(shape.kind).alias("kind"), orig.alias("orig"))

    found = F.transform(F.filter(matches(text, shape.regex), counts), span)
    guard = text.contains(shape.guard) if len(shape.guard) == 1 else text.rlike(shape.guard)
    return F.when(guard, found).otherwise(F.array().cast(SPAN)).cast(SPAN)


def candidates(text: Column, kinds: tuple[str, ...] = KINDS, first_prio: int = 10) -> Column:
    """Spans of all these kinds, not resolved yet. Their priority continues from first_prio."""
    return F.concat(*[shape_spans(text, s, first_prio + i) for i, s in enumerate(SHAPES) if s.kind in kinds])

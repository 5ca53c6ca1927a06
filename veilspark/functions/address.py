"""Japanese addresses as column expressions.

A lot is found first: numbers that the words for a lot or hyphens join. What stands before it is read
backwards as a place: its characters up to the first sign, cut behind each word for a level of
administration. The first cut whose head ends in a municipality, and whose rest can be a town, decides.
Hiragana can be of a town unless it is made up of function words, as between two words of a sentence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import DIGIT, HYPHEN, let, matches, pieces
from .text import addr_canon

# Municipalities with kana in their names, from north to south. Those of the modelled
# behaviour, and five more; not checked against the national register.
KANA_MUNICIPALITIES = (
    "上ノ国町 せたな町 ニセコ町 むかわ町 えりも町 新ひだか町 むつ市 つがる市 おいらせ町 にかほ市 いわき市 つくば市 ひたちなか市 かすみがうら市 つくばみらい市 "
    "さくら市 みどり市 みなかみ町 さいたま市 ふじみ野市 ときがわ町 いすみ市 あきる野市 日の出町 かほく市 あわら市 おおい町 南アルプス市 伊豆の国市 みよし市 あま市 "
    "いなべ市 南あわじ市 たつの市 かつらぎ町 紀の川市 すさみ町 みなべ町 西ノ島町 隠岐の島町 つるぎ町 東みよし町 さぬき市 東かがわ市 まんのう町 いの町 うきは市 みやま市 みやこ町 "
    "みやき町 あさぎり町 えびの市 いちき串木野市 南さつま市 さつま町 うるま市"
).split()
SOLID = r"[\p{IsHan}\p{IsKatakana}ー]"
HIRAGANA = r"\p{IsHiragana}"
LEVEL = "[市区町村郡]"
PREFECTURE = r"(?:東京都|北海道|京都府|大阪府|\p{IsHan}{2,3}県)"
#: Words that only sentences have; hiragana made up of them isn't of a name, but for a single の.
FUNCTION_WORDS = ("から", "まで", "より", "など", "ほど", "だけ", "くらい", "ぐらい", "ごろ", "なら", "です", "ある", "いる", "する", "した", "して", "さん", "さま", "ちゃん", "は", "が", "を", "に", "で", "と", "へ", "も", "や", "の")
#: Characters of a place, of a town in it, and of a municipality in kanji or behind a prefecture.
PLACE_CHARS, TOWN_CHARS, KANJI_CHARS, NAME_CHARS = 40, 16, 6, 9
_WORD = "(?:丁目|番地|番|号)"
_NUMERAL = f"(?:{DIGIT}++|[一二三四五六七八九十]++(?=丁目))"
_JOINED = rf"[ 　]?(?:{_WORD}[ 　]?(?:の|{HYPHEN})?|の|{HYPHEN})[ 　]?{DIGIT}++"
#: Two to four numbers, or one with the word for a lot.
LOT = rf"(?:{_NUMERAL}(?:{_JOINED}){{1,3}}(?:[ 　]?(?:番地|番|号))?|{DIGIT}++[ 　]?番地)"
BUILDING = "ハイツ|コーポ|マンション|アパート|荘|ビル|住宅|団地|レジデンス|メゾン|ハウス|寮|館|棟"
ROOM = rf"(?:[A-Za-zＡ-Ｚ]?[-－‐]?{DIGIT}{{1,4}}(?:号室|号|室)?)"
_NAME_PART = r"[^\s　、。（）()【】]"
TAIL = rf"(?:[ 　]{{1,2}}{_NAME_PART}{{0,12}}(?:{BUILDING}){_NAME_PART}{{0,8}}(?:[ 　]{ROOM})?|[ 　]{{1,2}}{ROOM}(?=$|[\s　、。）)]))"
POSTAL = rf"〒?{DIGIT}{{3}}{HYPHEN}{DIGIT}{{4}}[ 　]{{0,2}}"


def _sentence(c: Column) -> Column:
    """Whether hiragana in it is made up of function words."""
    stretches = F.regexp_extract_all(c, F.lit(f"{HIRAGANA}+"), F.lit(0))
    return c.contains("を") | F.exists(stretches, lambda h: (h != "の") & h.rlike(f"^(?:{'|'.join(FUNCTION_WORDS)})+$"))


def _municipality(head: Column) -> Column:
    """The municipality that a text ends in, with its prefecture; empty without one."""
    whole = F.regexp_extract(head, f"{PREFECTURE}[^県]{{2,{NAME_CHARS}}}$", 0)
    kana = F.regexp_extract(head, f"(?:{'|'.join(sorted(KANA_MUNICIPALITIES, key=len, reverse=True))})$", 0)
    kanji = F.right(F.regexp_extract(head, r"[\p{IsHan}ヶケ]+$", 0), F.lit(KANJI_CHARS))
    # In this order; a single character is a level without a name.
    return F.coalesce(F.get(F.filter(F.array(F.when(~_sentence(whole), whole), kana, kanji), lambda n: F.length(n) > 1), F.lit(0)), F.lit(""))


def _place(before: Column) -> Column:
    """The place that a text ends in, from its municipality on; empty without one."""
    run = F.regexp_extract(F.right(before, F.lit(PLACE_CHARS)), f"(?:{SOLID}|{HIRAGANA})+$", 0)

    def first(parts: Column) -> Column:
        def cut(k: Column) -> Column:
            return F.struct(_municipality(F.array_join(F.slice(parts, 1, k), "")).alias("name"), F.array_join(F.slice(parts, k + 1, F.size(parts)), "").alias("town"))

        cuts = F.transform(F.slice(F.sequence(F.lit(1), F.size(parts)), 1, F.size(parts) - 1), cut)
        good = F.filter(cuts, lambda c: (c["name"] != "") & (F.length(c["town"]) <= TOWN_CHARS) & ~_sentence(c["town"]))
        return F.coalesce(F.get(F.transform(good, lambda c: F.concat(c["name"], c["town"])), F.lit(0)), F.lit(""))

    return let(pieces(run, f"(?<={LEVEL})"), first)


def address_spans(text: Column) -> Column:
    """Addresses with municipality and lot: array<struct<st, orig, before, after>>, where before and after
    are up to 64 characters around them."""
    none = F.array().cast("array<struct<st:int,orig:string,before:string,after:string>>")

    def placed(m: Column) -> Column:
        return F.struct(m["st"].alias("st"), _place(m["before"]).alias("place"), m["orig"].alias("lot"))

    def span(p: Column) -> Column:
        st, orig = p["st"] - F.length(p["place"]), F.concat(p["place"], p["lot"])
        return F.struct(st.cast("int").alias("st"), orig.alias("orig"), F.right(F.left(text, st), F.lit(64)).alias("before"), F.substring(text, st + F.length(orig) + 1, F.lit(64)).alias("after"))

    found = F.transform(F.filter(matches(text, LOT), lambda m: m["before"].rlike(LEVEL)), placed)
    return F.when(text.rlike(f"{LEVEL}.*{DIGIT}"), F.transform(F.filter(found, lambda p: p["place"] != ""), span)).otherwise(none)


def with_tail(span: Column) -> Column:
    """An address span with the building and room that follow it: struct<st, orig>."""
    return F.struct(span["st"].alias("st"), F.concat(span["orig"], F.regexp_extract(span["after"], f"^{TAIL}", 0)).alias("orig"))


def address_lumps(text: Column) -> Column:
    """Address spans with their tails and a postal code directly before them, with the canonical form
    of the part up to the lot: array<struct<st, len, core>>."""
    def lump(span: Column) -> Column:
        head = F.length(F.regexp_extract(span["before"], f"{POSTAL}$", 0))
        return F.struct((span["st"] - head).alias("st"), (head + F.length(with_tail(span)["orig"])).alias("len"), addr_canon(span["orig"]).alias("core"))

    return F.transform(address_spans(text), lump)


def has_lot(c: Column) -> Column:
    return c.rlike(LOT)


def registered_core(c: Column) -> Column:
    """Canonical form of a registered address up to its lot, null without one."""
    found = F.regexp_extract(c, f"^.*?{LOT}", 0)
    return F.when(found != "", addr_canon(found))

"""Scalar functions on strings, dates and spreadsheet cells, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the Japanese scripts that the functions fold.
HALF_DIGITS, FULL_DIGITS = "0123456789", "０１２３４５６７８９"
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
DASHES = "－―‐−ー–—"
#: Glyphs that stand for a hidden character in a name; the first is the canonical one.
MASK_GLYPHS = "〇○◯●◎□■△▲×✕＊*＿_…"
#: Eras, their letter and the year before their first.
ERAS = (("明治", "M", 1867), ("大正", "T", 1911), ("昭和", "S", 1925), ("平成", "H", 1988), ("令和", "R", 2018))
WEEKDAYS = "日月火水木金土"
#: First kana of each row of the kana table.
KANA_ROWS = (("ア", "アイウエオァィゥェォヴ"), ("カ", "カキクケコガギグゲゴ"), ("サ", "サシスセソザジズゼゾ"), ("タ", "タチツテトダヂヅデドッ"), ("ナ", "ナニヌネノ"), ("ハ", "ハヒフヘホバビブベボパピプペポ"), ("マ", "マミムメモ"), ("ヤ", "ヤユヨャュョ"), ("ラ", "ラリルレロ"), ("ワ", "ワヲンヮ"))


def norm_name(c: Column) -> Column:
    """A name without half- and full-width spaces."""
    return F.translate(c, " 　", "")


def norm_space(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"[\s　]+", "")


def clean_name(c: Column) -> Column:
    """Runs of spaces as one half-width space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s　]+", " "))


def half_digits(c: Column) -> Column:
    return F.translate(c, FULL_DIGITS + "Ｒ．", HALF_DIGITS + "R.")


def half_width(c: Column) -> Column:
    """Full-width letters and digits as half-width capitals, without spaces."""
    full = "".join(chr(x) for x in range(0xFF21, 0xFF3B)) + "".join(chr(x) for x in range(0xFF41, 0xFF5B))
    latin = "".join(map(chr, range(65, 91)))
    return F.upper(norm_name(F.translate(c, FULL_DIGITS + full, HALF_DIGITS + latin + latin)))


def hiragana(c: Column) -> Column:
    return F.translate(c, KATAKANA, HIRAGANA)


def katakana(c: Column) -> Column:
    return F.translate(c, HIRAGANA, KATAKANA)


def mask_key(c: Column) -> Column:
    """A partly hidden name with all masking glyphs made equal."""
    return F.translate(c, MASK_GLYPHS, MASK_GLYPHS[0] * len(MASK_GLYPHS))


def sanitize_prefix(c: Column) -> Column:
    """A kind as it may stand in a code: no brackets, bars, digits or spaces; 人物 if nothing is left."""
    cleaned = F.regexp_replace(c, r"[\s　【】|｜0-9０-９]", "")
    return F.when(cleaned == "", "人物").otherwise(cleaned)


def addr_norm(c: Column) -> Column:
    """Address for comparison: half width, one kind of dash, no spaces, breaks or separators."""
    return F.regexp_replace(F.translate(half_width(c), DASHES, "-" * len(DASHES)), r"[\s　｜|]+|_x000[aAdD]_", "")


def addr_canon(c: Column) -> Column:
    """addr_norm without a leading postal code and prefecture."""
    return F.regexp_replace(F.regexp_replace(addr_norm(c), r"^〒?\d{3}-?\d{4}", ""), r"^(?:東京都|北海道|(?:京都|大阪)府|[\p{IsHan}]{2,3}県)", "")


def alias_list(c: Column) -> Column:
    """Aliases split at slashes and commas, trimmed, without empty ones and repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[/／、,，]"), clean_name), lambda a: a != ""))


def clean_alias(c: Column) -> Column:
    return F.array_join(alias_list(c), "／")


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def one_line(c: Column) -> Column:
    return F.regexp_replace(c, r"\r?\n", "／")


def xml_safe(c: Column) -> Column:
    """Without the control characters that XML forbids."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def note_safe(c: Column) -> Column:
    """As a cell of a markdown table: no control or zero-width characters, line breaks or bars."""
    return F.trim(F.replace(one_line(F.regexp_replace(c, r"[\x00-\x08\x0b-\x0c\x0e-\x1f​-‍﻿]", "")), F.lit("|"), F.lit("｜")))


def pasted(c: Column) -> Column:
    """Pasted text: line feeds only, no spaces at line ends."""
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"(?m)[ \t　]+$", "")


def tsv_escape(c: Column) -> Column:
    r"""Backslash, tab and line feed as \\, \t and \n; carriage returns go."""
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit(""))


def tsv_unescape(c: Column) -> Column:
    """The inverse of tsv_escape, by a stand-in for the double backslash."""
    hidden = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    return F.replace(F.replace(F.replace(hidden, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))


def rune_width(c: Column) -> Column:
    """Display width of one character: tab 2, Latin and half-width kana 0.5, others 1."""
    return F.when(c == "\t", 2.0).when(c.rlike(r"^[\x20-\x7e｡-ﾟ]$"), 0.5).otherwise(1.0)


def display_width(c: Column) -> Column:
    halves = F.length(F.regexp_replace(c, r"[^\x20-\x7e｡-ﾟ]", ""))
    tabs = F.length(F.regexp_replace(c, r"[^\t]", ""))
    return F.length(c) - halves * 0.5 + tabs


def line_cost(c: Column, width: int = 48) -> Column:
    """Printed lines that a paragraph takes; an empty one takes one."""
    return F.greatest(F.lit(1), F.ceil(display_width(c) / width)).cast("int")


def column_number(c: Column) -> Column:
    """Number of a spreadsheet column: A is 1, AA is 27."""
    return F.aggregate(F.split(F.upper(c), ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def column_name(c: Column) -> Column:
    """Letters of a spreadsheet column number, up to three."""
    def letter(n: Column) -> Column:
        return F.chr(n + 65)

    one, two = c - 1, F.floor((c - 27) / 26)
    three = F.floor((c - 703) / 676)
    return F.when(c <= 26, letter(one)).when(c <= 702, F.concat(letter(two), letter(F.pmod(c - 27, F.lit(26))))).otherwise(F.concat(letter(three), letter(F.pmod(F.floor((c - 703) / 26), F.lit(26))), letter(F.pmod(c - 703, F.lit(26)))))


def cell_column(ref: Column) -> Column:
    return column_number(F.regexp_extract(ref, "^([A-Za-z]+)", 1))


def cell_row(ref: Column) -> Column:
    return F.regexp_extract(ref, "([0-9]+)$", 1).try_cast("int")


def serial(d: Column) -> Column:
    """Spreadsheet serial of a date."""
    return F.datediff(d, F.lit("1899-12-30").cast("date"))


def from_serial(n: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int"))


def valid_date(y: Column, m: Column, d: Column, first: int = 1990, last: int = 2100) -> Column:
    """Date of year, month and day, null if there is none or the year is out of range."""
    text = F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int"))
    return F.when(y.between(first, last) & m.between(1, 12) & d.between(1, 31), F.try_to_date(text, "yyyy-MM-dd"))


def iso_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def era_year(era: Column, year: Column) -> Column:
    """Western year of an era (name or letter) and its year."""
    base = F.lit(None).cast("int")
    for name, letter, before in reversed(ERAS):
        base = F.when(F.upper(era).isin(name, letter), before).otherwise(base)
    return base + year.cast("int")


FLEX_DATE = r"^\s*(明治|大正|昭和|平成|令和|[MTSHRmtshr])?\.?\s*(元|\d{1,4})\s*[年./\-]\s*(\d{1,2})\s*[月./\-]\s*(\d{1,2})\s*日?\s*$"


def flexible_date(c: Column) -> Column:
    """Date from an era or western spelling or a spreadsheet serial, null if it is none."""
    text = half_digits(c)
    part = [F.regexp_extract(text, FLEX_DATE, i) for i in range(1, 5)]
    number = F.when(part[1] == "元", 1).otherwise(part[1].try_cast("int"))
    year = F.when(part[0] == "", number).otherwise(era_year(part[0], number))
    plain = valid_date(year, part[2].try_cast("int"), part[3].try_cast("int"), 1850, 2200)
    return F.coalesce(plain, F.when(text.rlike(r"^\d{4,5}$"), from_serial(text.try_cast("int"))))


def era_long(d: Column) -> Column:
    """A date in its era, as 令和6年4月1日; the first year is 元年."""
    out = F.lit(None).cast("string")
    starts = ("1868-01-25", "1912-07-30", "1926-12-25", "1989-01-08", "2019-05-01")
    for (name, _, before), start in zip(ERAS, starts, strict=True):
        n = F.year(d) - before
        text = F.concat(F.lit(name), F.when(n == 1, "元").otherwise(n.cast("string")), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日"))
        out = F.when(d >= F.lit(start).cast("date"), text).otherwise(out)
    return out


def era_short(d: Column) -> Column:
    """Reiwa year, month and day, as R6.4.1."""
    return F.concat(F.lit("R"), (F.year(d) - ERAS[-1][2]).cast("string"), F.lit("."), F.month(d).cast("string"), F.lit("."), F.dayofmonth(d).cast("string"))


def weekday(d: Column) -> Column:
    return F.substring(F.lit(WEEKDAYS), F.dayofweek(d), F.lit(1))


def kana_row(c: Column) -> Column:
    """Row of the kana table that a reading starts with, 他 for others."""
    first, out = F.left(katakana(F.trim(c)), F.lit(1)), F.lit("他")
    for row, letters in KANA_ROWS:
        out = F.when(first.isin(*letters), row).otherwise(out)
    return out


def care_level(c: Column) -> Column:
    """Care level 1 to 5, else null."""
    return F.regexp_extract(half_digits(norm_space(c)), r"^要介護([1-5])$", 1).try_cast("int")


def care_reason(c: Column) -> Column:
    """Why there is no care level."""
    text = norm_space(c)
    return F.when(care_level(c).isNotNull(), F.lit(None)).when(text == "", "blank").when(text.startswith("要支援"), "support level").otherwise("unreadable")


def joined_address(*parts: Column) -> Column:
    return F.concat_ws("　", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])


def job_folder(c: Column) -> Column:
    """struct<person, document, month> of a folder named person_document（month）."""
    shape = r"^([^_]+)_([^（(]+)(?:[（(]([^）)]*)[）)])?$"
    return F.struct(*[F.regexp_extract(c, shape, i).alias(n) for i, n in enumerate(("person", "document", "month"), 1)])


def word_shape(c: Column) -> Column:
    """What kind of word it is, telling nothing of it."""
    return F.when(c.rlike(r"^[0-9０-９\-－ー]+$"), "digits").when(c.rlike(r"^[\p{IsHan}々]+$"), "kanji").when(c.rlike(r"^[\p{IsHiragana}ー]+$"), "hiragana").when(c.rlike(r"^[\p{IsKatakana}ー]+$"), "katakana").when(c.rlike(r"^[\x21-\x7e]+$"), "latin").otherwise("mixed")

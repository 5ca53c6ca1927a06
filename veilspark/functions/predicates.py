"""Predicates on words and names of files, as boolean column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MASK_GLYPHS, half_width

# This library's own word lists.
PLACEHOLDERS = ("なし", "無し", "無", "同上", "不明", "該当なし", "特になし", "未定", "－", "-", "ー")
ORGANISATIONS = "事業所|センター|クリニック|病院|医院|薬局|株式会社|有限会社|法人|ステーション|役所|支援所|ホーム|施設|デイサービス"
KINSHIP = ("父", "母", "夫", "妻", "息子", "娘", "長男", "長女", "次男", "次女", "三男", "三女", "兄", "姉", "弟", "妹", "嫁", "孫", "義母", "義父", "叔父", "叔母")
COUNTERS = "回|人|名|個|本|枚|時間|分|日|週|か月|ヶ月|年|歳|才|階|km|cm|kg|mg|ml|円|割|％|%"
JOBS = "看護師|保健師|介護士|介護福祉士|相談員|ケアマネジャー|介護支援専門員|ヘルパー|理学療法士|作業療法士|言語聴覚士|医師|主任|管理者|薬剤師"
KANJI_NUMBER = "[一二三四五六七八九十百千]"


def is_han(c: Column) -> Column:
    return c.rlike(r"^[\p{IsHan}々〆ヶ&&[^〇]]+$")


def is_hiragana(c: Column) -> Column:
    return c.rlike(r"^[\p{IsHiragana}ー]+$")


def is_katakana(c: Column) -> Column:
    return c.rlike(r"^[\p{IsKatakana}ー]+$")


def is_kana(c: Column) -> Column:
    return c.rlike(r"^[\p{IsHiragana}\p{IsKatakana}ー]+$")


def has_digit(c: Column) -> Column:
    return c.rlike("[0-9０-９]")


def is_placeholder(c: Column) -> Column:
    return F.trim(c).isin(*PLACEHOLDERS)


def is_organisation(c: Column) -> Column:
    return c.rlike(f"(?:{ORGANISATIONS})$")


def is_kinship(c: Column) -> Column:
    return c.isin(*KINSHIP)


def is_job(c: Column) -> Column:
    return c.rlike(f"(?:{JOBS})$")


def job_suffix(c: Column) -> Column:
    """The job that a word ends with, '' if none."""
    return F.regexp_extract(c, f"({JOBS})$", 1)


def has_counter(c: Column) -> Column:
    return c.rlike(f"[0-9０-９](?:{COUNTERS})")


def is_kanji_number(c: Column) -> Column:
    return c.rlike(f"^{KANJI_NUMBER}+(?:{COUNTERS})$")


def is_masked(c: Column) -> Column:
    """Masking glyphs only."""
    return (c != "") & (F.translate(c, MASK_GLYPHS, "") == "")


def has_mask_and_han(c: Column) -> Column:
    shown = F.translate(c, MASK_GLYPHS, "")
    return (shown != c) & shown.rlike(r"\p{IsHan}")


def no_person(c: Column) -> Column:
    return is_organisation(c) | is_masked(c)


def same_digit_run(c: Column) -> Column:
    return F.regexp_replace(c, "[-－ー]", "").rlike(r"^(\d)\1{5,}$")


def escape_only(c: Column) -> Column:
    """Nothing but spreadsheet escapes such as _x000D_."""
    return c.rlike(r"^(?:_x00[0-9A-Fa-f]{2}_)+$")


def is_checkbox(c: Column) -> Column:
    """What OCR makes of an empty check box."""
    return c.isin("口", "□", "ロ", "☐")


#: What may stand behind the digits of a room.
ROOM_ENDS = ("号室", "号", "室")


def _room(c: Column) -> tuple[Column, Column, Column]:
    """Whether a text is a room, its wing and what stands behind its digits: up to four digits in one group,
    behind at most one Latin letter, from which a hyphen may part them."""
    parts, digits = F.split(c, "[0-9０-９]+", -1), F.regexp_extract(c, "[0-9０-９]+", 0)
    wing, end = F.regexp_replace(F.get(parts, F.lit(0)), "[-－‐]$", ""), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    is_wing = (wing == "") | (F.length(wing) == 1) & F.upper(half_width(wing)).between("A", "Z")
    return (F.size(parts) == 2) & F.length(digits).between(1, 4) & is_wing & ((end == "") | end.isin(*ROOM_ENDS)), wing, end


def room_number(c: Column) -> Column:
    return _room(c)[0]


def strong_room(c: Column) -> Column:
    """A room that can't be a bare number."""
    room, wing, end = _room(c)
    return room & ((wing != "") | (end != ""))


def safe_name(c: Column) -> Column:
    """A file name without path, control characters or leading dot."""
    return c.rlike(r'^[^\x00-\x1f/\\:*?"<>|.][^\x00-\x1f/\\:*?"<>|]*$')


def safe_path(c: Column) -> Column:
    """A relative path of at most two levels of safe names."""
    return c.rlike(r'^[^\x00-\x1f/\\:*?"<>|.][^\x00-\x1f/\\:*?"<>|]*(?:/[^\x00-\x1f/\\:*?"<>|.][^\x00-\x1f/\\:*?"<>|]*)?$')


def within(path: Column, root: Column) -> Column:
    return (path == root) | path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def bad_name(c: Column) -> Column:
    """Why a registry name isn't accepted, null if it is."""
    bare = F.regexp_replace(c, r"[\s　]", "")
    return F.when(bare == "", "blank").when(F.length(bare) > 40, "too long").when(c.rlike("[【】|｜\t\n]"), "reserved character").when(is_placeholder(c), "placeholder").when(bare.rlike(r"^[\p{IsPunctuation}]+$"), "symbols only")


def drug_word(c: Column, drug_document: Column) -> Column:
    """A word that is taken for a drug in a drug document."""
    return drug_document & (c.rlike("錠|カプセル|散|軟膏|点眼|内服|外用|食後|食前|眠前|頓服") | (F.length(c) == 1) | (is_katakana(c) & (F.length(c) >= 3)))

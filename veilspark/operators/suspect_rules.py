"""Further detectors of what may still identify somebody in a masked text, beside those of `suspects`.

Each takes units (UNIT, text) and returns UNIT, rule, word, st, context, reason. A rule is an expression
over what stands around a name; its word lists are parameters. The OCR rules are for scanned texts, in
which glyphs were misread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import BUILDING
from ..functions.patterns import DATE, DIGIT, HYPHEN, located, matches
from ..storage import shuffled
from .suspects import HAN, JOBS, NAME_LABELS, PERSON_NOUNS, TITLES, _any, _out, honoured_words

KIN = ("長男", "長女", "次男", "次女", "三男", "三女", "妻", "夫", "息子", "娘", "兄", "姉", "弟", "妹", "父", "母", "孫", "嫁", "叔父", "叔母")
CONTACTS = ("連絡先", "緊急連絡先", "キーパーソン", "保証人", "身元引受人", "後見人", "同居者", "主介護者")
FIELDS = ("住所", "現住所", "生年月日", "フリガナ", "ふりがな", "電話番号", "携帯")
WORK = ("訪問", "面談", "来所", "電話", "連絡", "相談", "同行", "送迎", "入浴")
SURNAMES = tuple("佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 林 清水 山崎".split())
GARBLE = "[〓□■◆�?？*＊]"
NAME = rf"{HAN}{{2,4}}"
SPACED = rf"{HAN}{{1,3}}[ 　]{HAN}{{1,3}}"
END = r"(?=$|[\s　、。，,）)】／/（(]|様|さん|氏|殿)"


def glued_labels(units: DataFrame, labels: tuple[str, ...] = NAME_LABELS) -> DataFrame:
    """A name right after the label of a name field, with nothing between them."""
    return _out(units.filter(F.col("text").rlike(_any(labels))), located(F.col("text"), rf"(?<={_any(labels)})(?:{SPACED}|{HAN}{{3,4}}){END}"), "glued label", "name: stuck to a name label")


def beside_nurses(units: DataFrame, titles: tuple[str, ...] = ("Ns", "NS", "Ｎｓ", "看護師")) -> DataFrame:
    """A short kanji word before or after the title of a nurse."""
    shape = rf"(?<!{HAN})(?!{_any(PERSON_NOUNS)}|担当|訪問){HAN}{{1,3}}(?=[ 　]?{_any(titles)})|(?<={_any(titles)}[：: 　]){HAN}{{1,3}}{END}"
    return _out(units.filter(F.col("text").rlike(_any(titles))), located(F.col("text"), shape), "nurse", "name: beside a nurse")


def kana_with_ko(units: DataFrame) -> DataFrame:
    """Hiragana that ends in the kanji of women's names, with a title."""
    shape = rf"(?<!\p{{IsHiragana}})\p{{IsHiragana}}{{1,3}}子(?:{'|'.join(TITLES)})"
    return _out(units.filter(F.col("text").contains("子")), located(F.col("text"), shape), "kana ko", "name: before a title")


def fields_in_text(units: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """What follows the label of a field in the same text: digits for an address, a date or a number, kana
    for a reading."""
    shape = rf"(?<={_any(fields)}[：: 　]{{1,2}})[^\s　、。【】：:][^、。【】：:]{{2,30}}"
    found = F.filter(matches(F.col("text"), shape), lambda m: m["orig"].rlike(DIGIT) | m["before"].rlike("(?:フリガナ|ふりがな)[：: 　]{1,2}$") & m["orig"].rlike(r"^[\p{IsHiragana}\p{IsKatakana}ー 　]+$"))
    return _out(units.filter(F.col("text").rlike(_any(fields))), found, "field", "entry of a field")


def dashed_lots(units: DataFrame) -> DataFrame:
    """A place with a lot of three numbers, without a municipality."""
    shape = rf"(?<![\p{{IsHan}}\p{{IsKatakana}}])[\p{{IsHan}}\p{{IsKatakana}}ヶケ]{{2,8}}{DIGIT}{{1,4}}{HYPHEN}{DIGIT}{{1,4}}{HYPHEN}{DIGIT}{{1,4}}(?!{DIGIT}|{HYPHEN})"
    found = F.filter(located(F.col("text"), shape), lambda m: ~m["orig"].rlike("^(?:電話|携帯|番号|日付|自宅|連絡先)"))
    return _out(units.filter(F.col("text").rlike(f"{DIGIT}{HYPHEN}{DIGIT}")), found, "dashed lot", "address: down to the lot")


def contact_labels(units: DataFrame, labels: tuple[str, ...] = CONTACTS + KIN) -> DataFrame:
    """A name after the label of a contact or of kin and a separator."""
    shape = rf"(?<={_any(labels)}[：:・（(])[ 　]?(?!{_any(PERSON_NOUNS + KIN)})(?:{SPACED}|{NAME}){END}"
    return _out(units.filter(F.col("text").rlike(_any(labels))), located(F.col("text"), shape), "contact", "name: in a name field")


def kin_with_names(units: DataFrame, kin: tuple[str, ...] = KIN) -> DataFrame:
    """A spaced full name after a word for kin."""
    return _out(units.filter(F.col("text").rlike(_any(kin))), located(F.col("text"), rf"(?<={_any(kin)}[の 　]){SPACED}{END}"), "kin", "name: alone")


def given_after_codes(units: DataFrame) -> DataFrame:
    """A short kanji word right after a code of a person, as another given name after a masked surname."""
    found = F.filter(located(F.col("text"), rf"(?<=【[^【】]{{1,40}}】[ 　]?){HAN}{{1,3}}{END}"), lambda m: ~m["orig"].rlike(rf"^(?:{'|'.join((*TITLES, *JOBS, *KIN, *WORK))}|殿|方|宅|家|の|生|歳|頃|分|時|号)"))
    return _out(units.filter(F.col("text").contains("】")), found, "given", "name: behind a code")


def wide_era_dates(units: DataFrame) -> DataFrame:
    """Dates of the two eras before 1989 that still stand."""
    return _out(units.filter(F.col("text").rlike("大正|昭和")), located(F.col("text"), rf"(?:大正|昭和)[ 　]?(?:{DIGIT}{{1,2}}|元)[ 　]?年(?:[ 　]?{DIGIT}{{1,2}}[ 　]?月(?:[ 　]?{DIGIT}{{1,2}}[ 　]?日)?)?"), "era date", "date: of birth")


def jobs_with_names(units: DataFrame, jobs: tuple[str, ...] = JOBS, surnames: tuple[str, ...] = SURNAMES) -> DataFrame:
    """A kanji word next to a job, if it is a common surname or stands before a title elsewhere in its
    document."""
    shape = rf"(?<={_any(jobs)}[：:の・ 　]?)(?!{_any(jobs)}){HAN}{{1,4}}{END}|(?<!{HAN}){HAN}{{1,4}}?(?=[ 　]?{_any(jobs)})"
    found = _out(units.filter(F.col("text").rlike(_any(jobs))), located(F.col("text"), shape), "job", "name: behind a job")
    known = honoured_words(units).withColumn("known", F.lit(True))
    # Each title makes up to four words, so known words are more than their guessed size says.
    return found.join(shuffled(known), ["doc_id", "word"], "left").filter(F.coalesce("known", F.lit(False)) | F.col("word").isin(*surnames)).select(found.columns)


def building_after_codes(units: DataFrame) -> DataFrame:
    """A building or room that was left after the code of an address."""
    shape = rf"(?<=【住所[0-9]{{3,6}}(?:の続き[0-9]{{0,3}})?】[ 　]{{0,2}})(?:[^\s　、。（）【】]{{0,12}}(?:{BUILDING})[^\s　、。（）【】]{{0,8}}|[A-Za-z]?{DIGIT}{{1,4}}号室?)"
    return _out(units.filter(F.col("text").contains("【住所")), located(F.col("text"), shape), "building", "address: down to the lot")


def dated_names(units: DataFrame, work: tuple[str, ...] = WORK) -> DataFrame:
    """OCR: a date, a name, and what was done."""
    return _out(units.filter(F.col("text").rlike(_any(work))), located(F.col("text"), rf"(?<={DATE}[ 　]{{1,2}})(?!{_any(PERSON_NOUNS)}){HAN}{{2,4}}(?=[ 　]{{1,2}}{_any(work)})"), "dated", "name: behind a date")


def garbled_names(units: DataFrame) -> DataFrame:
    """OCR: a word with a misread glyph before a title."""
    shape = rf"(?:{HAN}{{1,3}}{GARBLE}{{1,2}}{HAN}{{0,2}}|{GARBLE}{{1,2}}{HAN}{{1,3}})[ 　]?(?:{'|'.join(TITLES)})"
    return _out(units.filter(F.col("text").rlike(GARBLE)), located(F.col("text"), shape), "garbled", "name: before a title")


def beside_codes(units: DataFrame) -> DataFrame:
    """OCR: kanji stuck to a code of a person, as the rest of a name of which a part was known."""
    shape = rf"(?<!{HAN}){HAN}{{1,2}}(?=【(?:利用者|家族|その他|人物)[^【】]{{1,20}}】)"
    return _out(units.filter(F.col("text").contains("【")), F.filter(located(F.col("text"), shape), lambda m: ~m["orig"].isin(*KIN, "本人", "担当", "主治", "様", "氏")), "stuck", "name: touching a code")


#: Rules for all texts, and those for scanned ones.
RULES = (glued_labels, beside_nurses, kana_with_ko, fields_in_text, dashed_lots, contact_labels, kin_with_names, given_after_codes, wide_era_dates, jobs_with_names, building_after_codes)
OCR_RULES = (dated_names, garbled_names, beside_codes)

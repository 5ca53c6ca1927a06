"""Detectors of what may still identify somebody in a masked text. A suspect holds its document; it is
never replaced. Each detector takes units (UNIT, text) and returns UNIT, rule, word, st, context, reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.address import address_spans, with_tail
from ..functions.patterns import DATE, located, matches
from ..functions.text import norm_name
from ..storage import dimension_join, kept
from .mask import UNIT
from .registry import near_names
from .spans import context

# This library's own word lists; each is a parameter of its detector.
COMMON_HONORIFIC_WORDS = ("同様", "模様", "仕様", "多様", "一様", "異様", "王様", "様子", "様式", "様々", "様相", "氏名")
PERSON_NOUNS = ("本人", "ご本人", "利用者", "家族", "ご家族", "担当者", "主治医", "息子", "娘", "妻", "夫", "長男", "長女", "次男", "次女", "兄", "姉", "弟", "妹", "父", "母", "奥", "皆", "お客", "職員", "業者")
NAME_LABELS = ("氏名", "お名前", "利用者名", "フリガナ", "ふりがな", "担当者名", "連絡先氏名", "介護者", "緊急連絡先")
FIELD_LABELS = ("住所", "生年月日", "電話", "電話番号")
JOBS = ("看護師", "介護士", "相談員", "ケアマネジャー", "ヘルパー", "理学療法士", "医師", "主任")
DRUG_WORDS = ("錠", "カプセル", "散", "軟膏", "内服", "外用", "食後", "食前", "眠前", "朝食", "夕食", "用法", "用量", "処方", "薬局", "調剤", "頓服", "点眼", "湿布", "一包化")
DOSE = r"[0-9０-９]+\s?(?:mg|ｍｇ|ml|錠|包|カプセル|滴)"

#: Characters at a text's end that hold any date with the word behind it.
DATED_TAIL = 64
#: Kana, kanji, wide forms and their punctuation.
JAPANESE = "[\u3000-\u30ff\u3400-\u9fff\uf900-\ufaff\uff00-\uffef]"
HAN = r"[\p{IsHan}々〆ヶ]"
#: Titles that make the word before them a name, and the words that a name can be: kanji, katakana, or
#: hiragana before a familiar title.
TITLES = ("様", "さん", "氏", "ちゃん", "くん", "先生", "医師")
FAMILIAR = ("様", "ちゃん", "くん")
TITLE = "(?:" + "|".join(TITLES) + ")$"
NAME_BEFORE_TITLE = rf"(?:{HAN}{{1,6}}|[\p{{IsKatakana}}ー]{{2,8}})[ 　]?$"
HIRAGANA_BEFORE_TITLE = r"\p{IsHiragana}{2,4}$"


def titled(text: Column) -> Column:
    """Names with their title: array<struct<st, orig, after>>. Titles are found first, and then the word
    that each stands after."""
    def name(m: Column) -> Column:
        plain, kana = F.regexp_extract(m["before"], NAME_BEFORE_TITLE, 0), F.regexp_extract(m["before"], HIRAGANA_BEFORE_TITLE, 0)
        return F.when(plain != "", plain).when(m["orig"].isin(*FAMILIAR), kana).otherwise("")

    def whole(m: Column) -> Column:
        return F.struct((m["st"] - F.length(name(m))).alias("st"), F.concat(name(m), m["orig"]).alias("orig"), F.left(m["after"], F.lit(1)).alias("after"))

    found = matches(text, "|".join(TITLES))
    # Of titles in a row the first is the one that a name stands before.
    return F.transform(F.filter(found, lambda m: (name(m) != "") & ~m["before"].isin(*TITLES)), whole)


def _out(units: DataFrame, found: Column, rule: str, reason: str) -> DataFrame:
    rows = units.select(*UNIT, "text", F.explode(found).alias("m"))
    return rows.select(*UNIT, F.lit(rule).alias("rule"), F.col("m.orig").alias("word"), F.col("m.st").alias("st"), context(F.col("text"), F.col("m.st"), F.length("m.orig")).alias("context"), F.lit(reason).alias("reason"))


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


def honoured(units: DataFrame, common: tuple[str, ...] = COMMON_HONORIFIC_WORDS, nouns: tuple[str, ...] = PERSON_NOUNS) -> DataFrame:
    """Name-like words with an honorific, unless it belongs to a common word or a general noun."""
    text = F.col("text")

    def name_like(m: Column) -> Column:
        stem = F.regexp_replace(m["orig"], rf"[ 　]?{TITLE}", "")
        around = F.concat(m["orig"], m["after"])
        return ~around.rlike(_any(common)) & ~stem.rlike(f"{_any(nouns)}$") & ~stem.rlike(f"{_any(JOBS)}$") & ~(m["orig"].endswith("氏") & stem.rlike("[町村区市郡県都府道丁]"))

    guard = text.rlike("|".join(TITLES))
    return _out(units.filter(guard), F.filter(titled(text), name_like), "honoured", "name: before a title")


def unregistered_addresses(units: DataFrame) -> DataFrame:
    """Addresses with a lot number that are still there, with the building and room after them."""
    text = F.col("text")
    return _out(units.filter(text.rlike("[0-9０-９]")), F.transform(address_spans(text), with_tail), "address", "address: down to the lot")


def labelled_names(units: DataFrame, labels: tuple[str, ...] = NAME_LABELS) -> DataFrame:
    """A name-like word right after the label of a name field in the same text."""
    shape = rf"(?<={_any(labels)}[：: 　]{{1,2}}){HAN}{{1,4}}[ 　]?{HAN}{{0,4}}"
    return _out(units.filter(F.col("text").rlike(_any(labels))), located(F.col("text"), shape), "label", "name: in a name field")


def leftover_dates(units: DataFrame) -> DataFrame:
    """Dates beside the word for birth."""
    return _out(units.filter(F.col("text").contains("生")), located(F.col("text"), rf"(?<=生年月日[：: 　]{{0,2}}){DATE}"), "birth", "date: of birth")


def unhonoured(units: DataFrame) -> DataFrame:
    """Two short kanji words with one space between them that make up a whole text or stand before a job."""
    shape = rf"(?<!{HAN}){HAN}{{1,3}}[ 　]{HAN}{{1,3}}(?=$|[ 　]?{_any(JOBS)})"
    return _out(units, located(F.col("text"), shape), "unhonoured", "name: alone")


def beside_dates(units: DataFrame) -> DataFrame:
    """A date followed by nothing but a short kanji word to the end of the text."""
    # The word at the end decides first; a date is then looked for in what stands right before it only.
    text = F.rtrim("text", F.lit(" 　"))
    tail = F.right(text, F.lit(DATED_TAIL))
    found = F.transform(located(tail, rf"(?<={DATE}[ 　]{{0,2}}){HAN}{{2,4}}$"), lambda m: F.struct((F.length(text) - F.length(tail) + m["st"]).cast("int").alias("st"), m["orig"].alias("orig")))
    return _out(units.filter(F.right(text, F.lit(2)).rlike(f"^{HAN}{{2}}$") & tail.rlike("[0-9０-９元]")), found, "date", "name: behind a date")


def near_registered(units: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Kanji words that differ from a registered surface in exactly one character."""
    words = units.select(*UNIT, "text", F.explode(located(F.col("text"), f"{HAN}{{2,6}}")).alias("m"))
    found = near_names(words.select(F.col("m.orig").alias("word")), surfaces).select("word").distinct()
    rows = words.withColumn("word", F.col("m.orig")).join(found, "word")
    return rows.select(*UNIT, F.lit("near").alias("rule"), "word", F.col("m.st").alias("st"), context(F.col("text"), F.col("m.st"), F.length("word")).alias("context"), F.lit("name: one character from a registered one").alias("reason"))


def after_label(units: DataFrame, names: tuple[str, ...] = NAME_LABELS, fields: tuple[str, ...] = FIELD_LABELS) -> DataFrame:
    """The content of a unit whose previous unit in the same part is only a label: a name-like text after
    a name label, anything after a field label."""
    w = W.partitionBy("doc_id", "part_no").orderBy("seq")
    before = F.when(F.lag("seq").over(w) == F.col("seq") - 1, F.rtrim(F.lag("text").over(w), F.lit(" 　：:")))
    rows = units.withColumn("before", before).filter(~F.col("text").contains("【") & (F.trim("text") != ""))
    name = F.col("before").isin(*names) & F.col("text").rlike(rf"^[ 　]*{HAN}{{1,4}}[ 　]?{HAN}{{0,4}}[ 　]*$")
    field = F.col("before").isin(*fields) & F.col("text").rlike("[0-9０-９]")
    hit = rows.filter(name | field)
    return hit.select(*UNIT, F.when(name, "label cell").otherwise("field cell").alias("rule"), F.trim("text").alias("word"), F.lit(0).alias("st"), F.concat_ws("｜", "before", F.left("text", F.lit(30))).alias("context"), F.when(name, "name: in a name field").otherwise("entry of a field").alias("reason"))


def drug_documents(units: DataFrame, words: tuple[str, ...] = DRUG_WORDS, at_least: int = 4) -> DataFrame:
    """doc_id of documents with a dose and at least so many different drug words."""
    seen = [F.max(F.col("text").contains(w).cast("int")).alias(f"w{i}") for i, w in enumerate(words)]
    by = units.groupBy("doc_id").agg(F.max(F.col("text").rlike(DOSE).cast("int")).alias("dose"), *seen)
    return by.filter((F.col("dose") == 1) & (reduce(lambda a, b: a + b, [F.col(f"w{i}") for i in range(len(words))]) >= at_least)).select("doc_id")


def honoured_words(units: DataFrame) -> DataFrame:
    """Per document the words seen before an honorific, with all their endings of 1 to 4 characters."""
    stems = units.select("doc_id", F.explode(titled(F.col("text"))).alias("m")).select("doc_id", F.regexp_replace("m.orig", rf"[ 　]?{TITLE}", "").alias("stem"))
    ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.length("stem"))), lambda n: F.right("stem", n))
    return stems.filter("stem <> ''").select("doc_id", F.explode(ends).alias("word")).distinct()


def merge_contained(suspects: DataFrame) -> DataFrame:
    """In each unit, in order of detection: a word contained in an earlier one is dropped, a word that
    contains an earlier one takes its place. Words are compared without spaces and honorific."""
    bare = F.regexp_replace(norm_name(F.col("word")), TITLE, "")
    rows = suspects.withColumn("bare", F.when(bare == "", F.col("word")).otherwise(bare))
    kind = "array<struct<prio:int,st:int,rule:string,word:string,context:string,reason:string,bare:string>>"
    by = rows.groupBy(*UNIT).agg(F.array_sort(F.collect_list(F.struct("prio", "st", "rule", "word", "context", "reason", "bare"))).cast(kind).alias("all"))

    def step(acc: Column, s: Column) -> Column:
        inside = F.exists(acc, lambda o: o["bare"].contains(s["bare"]))
        holds = F.exists(acc, lambda o: s["bare"].contains(o["bare"]))
        return F.when(inside, acc).when(holds, F.array_distinct(F.transform(acc, lambda o: F.when(s["bare"].contains(o["bare"]), s).otherwise(o)))).otherwise(F.concat(acc, F.array(s)))

    return by.select(*UNIT, F.explode(F.aggregate("all", F.array().cast(kind), step)).alias("s")).select(*UNIT, "s.rule", "s.word", "s.st", "s.context", "s.reason")


def find(units: DataFrame, excluded: DataFrame, surfaces: DataFrame | None = None, scanned: bool = False) -> DataFrame:
    """All detectors over masked units, with those for scanned texts if they are, merged, without excluded
    words (`word`), and in drug documents without name suspects that are drug words."""
    from .suspect_rules import OCR_RULES, RULES

    # What a rule finds is Japanese or stands beside it; only an entry behind a label may have none itself.
    labels = units.filter(F.rtrim("text", F.lit(" 　：:")).isin(*NAME_LABELS, *FIELD_LABELS)).select("doc_id").distinct()
    entries = after_label(dimension_join(units, labels, "doc_id", "left_semi"))
    # Each rule reads this table of Japanese texts, not all texts again.
    units = kept(units.filter(F.col("text").rlike(JAPANESE)), "japanese")
    rules = [labelled_names(units), unregistered_addresses(units), honoured(units), leftover_dates(units), beside_dates(units), entries, unhonoured(units)]
    if surfaces is not None:
        rules.insert(5, near_registered(units, surfaces))
    rules += [rule(units) for rule in RULES + OCR_RULES * scanned]
    every = reduce(DataFrame.unionByName, [r.withColumn("prio", F.lit(i)) for i, r in enumerate(rules)])
    every = every.filter(~F.col("word").contains("【"))
    merged = merge_contained(every)
    bare = F.regexp_replace(norm_name(F.col("word")), TITLE, "")
    left = merged.withColumn("bare", bare).join(excluded.select(norm_name(F.col("word")).alias("bare")).distinct(), "bare", "left_anti")
    drug = drug_documents(units).withColumn("drug", F.lit(True))
    named = F.col("rule").isin("honoured", "label", "unhonoured", "date", "near", "glued label", "nurse", "contact", "kin", "given", "job", "dated", "stuck")
    drugs = "|".join(DRUG_WORDS)
    return left.join(drug, "doc_id", "left").filter(~(F.coalesce("drug", F.lit(False)) & named & (F.col("bare").rlike(drugs) | (F.length("bare") == 1)))).drop("drug", "bare")


def category(reason: Column) -> Column:
    """What a suspect's reason says it is: name, addr or other."""
    return F.when(reason.startswith("name"), "name").when(reason.startswith("address"), "addr").otherwise("other")

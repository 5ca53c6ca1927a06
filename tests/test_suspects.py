"""Detectors on invented texts."""

import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions.address import address_spans
from veilspark.functions.patterns import SHAPES, located, shape_spans
from veilspark.operators import registry, suspects

UNITS = "doc_id long, part_no int, seq int, text string"


def units(spark, *texts):
    return spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(texts)], UNITS)


def words(df):
    return sorted(r["word"] for r in df.collect())


@pytest.mark.parametrize(("text", "want"), [
    ("兄の家は埼玉県ふじみ野市上福岡7-8-9です。", "埼玉県ふじみ野市上福岡7-8-9"), ("転居先 うるま市石川2-40-1", "うるま市石川2-40-1"), ("本籍はかすみがうら市稲吉６－７", "かすみがうら市稲吉６－７"),
    ("送り先：伊豆の国市韮山12-3", "伊豆の国市韮山12-3"), ("朧月県あおぞら村東3番地", "朧月県あおぞら村東3番地"), ("千葉県いすみ市岬町九丁目10番11号へ送付", "千葉県いすみ市岬町九丁目10番11号"),
    ("北海道架空郡柚木町西4-5", "北海道架空郡柚木町西4-5"), ("（月影市くすのき台8-1-2）", "（月影市くすのき台8-1-2）"), ("実家は月影市ゆりの木3丁目2番地の5", "月影市ゆりの木3丁目2番地の5"),
    ("月影市うぐいすが森6-6", "月影市うぐいすが森6-6"), ("横町市から月影市本町2-3へ移った", "月影市本町2-3"), ("月影市はやぶさ11-12-13", "月影市はやぶさ11-12-13"),
])
def test_addresses(spark, text, want):
    found = units(spark, text).select(F.explode(address_spans(F.col("text"))).alias("s")).select("s.orig").collect()
    assert [r["orig"] for r in found] == [want.strip("（）")]


@pytest.mark.parametrize("text", ["毎市を2-3軒回る。", "月影市には5-6年いた。", "月影市へ7-8名で行く。", "月影市などで4-5か所を見た。", "月影市くらいなら2-3分", "あの町を3-4周した", "月影市と横町市が6-7位", "本市さまへ1-2件", "丘の上で2-3日"])
def test_no_addresses(spark, text):
    assert units(spark, text).select(F.explode(address_spans(F.col("text")))).count() == 0


@pytest.mark.parametrize(("kind", "text", "want"), [
    ("電話", "連絡先は0999-88-7777と03(1234)5678、06 7654 3210", ["0999-88-7777", "03(1234)5678", "06 7654 3210"]), ("電話", "番号 1234-56-7890 と 01-2-345 と 00999-88888-7777", []),
    ("古い日付", "大正9年1月2日、S.30.4.5、1964/7/8", ["大正9年1月2日", "S.30.4.5", "1964/7/8"]), ("古い日付", "平成9年1月2日、R5.6.7、1970年3月4日、966.1.2", []),
    ("生年月日", "生年月日： 平成2年3月4日 面談 令和5年6月7日、昭和8年9月10日 生まれ", ["平成2年3月4日", "昭和8年9月10日"]), ("年齢", "年齢：81歳（七十）で、(79才)の次に3歳、年齢 64", ["81歳", "79才", "64"]),
    ("郵便番号", "〒 123-4567と1234-5678と９９９－１１１１", ["〒 123-4567", "９９９－１１１１"]), ("番号", "12345678と1234567", ["12345678"]),
])
def test_shapes(spark, kind, text, want):
    shape = next(s for s in SHAPES if s.kind == kind)
    rows = units(spark, text, None, "", "なし").select("text", F.explode(shape_spans(F.col("text"), shape)).alias("s")).select("text", "s.*").collect()
    assert [r["orig"] for r in rows] == want and all(r["text"][r["st"] : r["st"] + r["len"]] == r["orig"] for r in rows)


def test_places_of_very_many_matches(spark):
    text = "".join(f"x{i}é{'9' * (i % 3)}" for i in range(20_000))
    got = units(spark, text).select(F.explode(located(F.col("text"), "[0-9]+")).alias("m")).select("m.*").collect()
    assert [(r["st"], r["orig"]) for r in got] == [(m.start(), m[0]) for m in re.finditer("[0-9]+", text)]


def test_honoured_words(spark):
    got = suspects.honoured(units(spark, "例田さんと同様に対応", "ご家族様へ", "模様を確認", "書式の様子", "みほちゃん", "神奈川氏名"))
    assert words(got) == ["みほちゃん", "例田さん"]


def test_label_in_previous_unit(spark):
    got = suspects.after_label(units(spark, "氏名：", "例田 次郎", "備考", "例田 次郎", "電話", "12-34"))
    assert [(r["rule"], r["word"]) for r in got.orderBy("seq").collect()] == [("label cell", "例田 次郎"), ("field cell", "12-34")]


def test_containment_keeps_the_longer(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 0, "a", "朔也さん", "", ""), (1, 0, 0, 1, 0, "b", "柚木朔也", "", ""), (1, 0, 0, 2, 5, "c", "木朔", "", ""), (1, 0, 0, 3, 9, "d", "莉央", "", "")], "doc_id long, part_no int, seq int, prio int, st int, rule string, word string, context string, reason string")
    assert [r["word"] for r in suspects.merge_contained(rows).collect()] == ["柚木朔也", "莉央"]


def test_excluded_and_drug_words(spark):
    text = ["梢田 美波", "処方 内服 5mg 1錠 食後", "薬局 用法 眠前", "一包 化様"]
    rows = units(spark, *text)
    none = spark.createDataFrame([], "word string")
    assert "梢田 美波" in words(suspects.find(rows, none))
    assert "梢田 美波" not in words(suspects.find(rows, spark.createDataFrame([("梢田美波",)], "word string")))
    assert [r["doc_id"] for r in suspects.drug_documents(rows).collect()] == [1]


def test_near_names_substitute_exactly_one(spark):
    w = spark.createDataFrame([("柚本朔也",), ("柚木朔也",), ("柚木太",), ("袖本朔也",)], "word string")
    s = spark.createDataFrame([("柚木朔也",)], "surface string")
    assert [(r["word"], r["at"]) for r in registry.near_names(w, s).collect()] == [("柚本朔也", 1)]


def test_categories(spark):
    df = spark.createDataFrame([("name: before a title",), ("address: down to the lot",), ("entry of a field",)], "r string")
    assert [r[0] for r in df.select(suspects.category(F.col("r"))).collect()] == ["name", "addr", "other"]


def test_names_behind_dates(spark):
    """At the end of a text, also of a long one, with blanks behind; not without a date right before."""
    texts = ["令和5年3月4日 柚木花子", "2024/3/4柚木", "令和5年3月4日", "令和5年3月4日  柚木　　", "柚木", "x" * 500 + "平成元年1月2日柚木花", "2024-1-2 ゆず", "2024.1.2柚木さん", "1日3回柚木", "", None]
    units = spark.createDataFrame([(i, 0, 0, t) for i, t in enumerate(texts)], "doc_id long, part_no int, seq int, text string")
    found = {(r.doc_id, r.word, texts[r.doc_id][r.st : r.st + len(r.word)]) for r in suspects.beside_dates(units).collect()}
    assert {i for i, _, _ in found} == {0, 1, 3} and all(word == there for _, word, there in found)

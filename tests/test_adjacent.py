"""Rules over neighbouring units and whole documents, and OCR repairs."""

from pyspark.sql import functions as F

from veilspark.functions import ocr
from veilspark.operators import adjacent

UNITS = "doc_id long, part_no int, seq int, text string"
SPANS = "doc_id long, space string, kind string, person string"
REGISTRY = "row_no int, kind string, name string, aliases array<string>, reading string"


def units(spark, *texts, column="text"):
    return spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(texts)], UNITS).withColumnRenamed("text", column)


def test_birth_label_before(spark):
    got = adjacent.birth_dates_after_label(units(spark, "生年月日：", " 昭和15年3月2日 生", "昭和1年1月1日"))
    assert [(r["seq"], r["st"], r["orig"]) for r in got.collect()] == [(1, 1, "昭和15年3月2日")]


def test_address_goes_on(spark):
    got = adjacent.address_continuations(units(spark, "住所 【住所001】", "鈴音ハイツ101号", "次", column="masked"))
    assert [(r["seq"], r["base_code"], r["orig"]) for r in got.collect()] == [(1, "【住所001】", "鈴音ハイツ101号")]


def test_single_characters(spark):
    reg = spark.createDataFrame([(1, "利用者", "林 実", [], "")], REGISTRY)
    got = adjacent.single_characters(units(spark, "林", "【利用者001の名】 林", "森林", "林業", "林様", "実 【利用者001】", column="masked"), reg)
    assert sorted((r["seq"], r["orig"]) for r in got.collect()) == [(0, "林"), (1, "林"), (4, "林"), (5, "実")]


def test_people_of_a_document_decide(spark):
    spans = spark.createDataFrame([(1, "名", "利用者", "柚木朔也"), (2, "名", "利用者", "柚木朔也"), (2, "名", "家族", "柚木莉央")], SPANS)
    people = spark.createDataFrame([("柚木朔也", "柚木"), ("柚木莉央", "柚木"), ("例田莉央", "例田")], "person string, surname string")
    owners = spark.createDataFrame([("莉央", "柚木莉央", "家族"), ("莉央", "例田莉央", "家族")], "surface string, person string, kind string")
    assert [tuple(r) for r in adjacent.sole_bearers(spans, people).collect()] == [(1, "柚木", "柚木朔也")]
    assert sorted((r["doc_id"], r["person"]) for r in adjacent.preferred(spans, owners, people).collect()) == [(1, "柚木莉央"), (2, "柚木莉央")]


def test_users_boxes_and_board(spark):
    rows = units(spark, "【利用者002】と【利用者001の名】", "【家族001】", column="masked")
    assert adjacent.users_of_documents(rows).first()["users"] == ["【利用者001】", "【利用者002】"]
    sus = spark.createDataFrame([(1, "朔也", "a【x001】b"), (1, "柚木朔也", "a【y002】b"), (1, "朔也", "c")], "doc_id int, word string, context string")
    assert sorted(r["word"] for r in adjacent.boxes(sus).collect()) == ["朔也", "柚木朔也"]
    reqs = spark.createDataFrame([("j", "済", i) for i in range(5)] + [("j", "未", i) for i in range(12)], "job string, state string, at int")
    assert adjacent.board(reqs).count() == 13


def test_readings(spark):
    got = adjacent.readings_of_people(units(spark, "フリガナ ユズキ サクヤ", "氏名"), spark.createDataFrame([(1, 1, "柚木朔也")], "doc_id long, seq int, person string"))
    assert [(r["reading"], r["person"]) for r in got.collect()] == [("ユズキ サクヤ", "柚木朔也")]


def test_ocr_repairs(spark):
    df = spark.createDataFrame([("見 本 さ ん O3-l234-5678 と BOOK",)], "t string")
    assert df.select(ocr.repaired(ocr.joined_wide(F.col("t")))).first()[0] == "柚木さん 03-1234-5678 と BOOK"

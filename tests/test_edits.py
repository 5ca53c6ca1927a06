"""Registry edits, predicates and fixed-shape sheets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilspark.functions import predicates as p
from veilspark.operators import codebook, edits, forms

REGISTRY = "row_no int, kind string, name string, aliases array<string>, reading string"


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([(1, "利用者", "柚木 朔也", ["タロ"], ""), (4, "除外", "梢田", [], "")], REGISTRY)


def test_rows_are_added_once(spark, registry):
    new = spark.createDataFrame([("利用者", "柚木朔也", [], ""), ("家族", "柚木 莉央", [], ""), ("家族", "柚木莉央", [], ""), ("家族", "なし", [], ""), ("家族", "  ", [], "")], "kind string, name string, aliases array<string>, reading string")
    after, refused = edits.added(registry, new)
    assert sorted((r["row_no"], r["name"]) for r in after.collect())[2:] == [(5, "柚木 莉央")]
    assert sorted(r["reason"] for r in refused.collect()) == ["blank", "exists", "given twice", "placeholder"]


def test_edits_check_what_was_seen(spark, registry):
    rows = [(1, "利用者", "柚木 朔也", "利用者", "柚木 次郎", [], ""), (4, "除外", "別", "除外", "x", [], ""), (9, "a", "b", None, None, None, None)]
    after, stale = edits.changed(registry, spark.createDataFrame(rows, "row_no int, old_kind string, old_name string, kind string, name string, aliases array<string>, reading string"))
    assert sorted(r["name"] for r in after.collect()) == ["柚木 次郎", "梢田"] and sorted(r["row_no"] for r in stale.collect()) == [4, 9]


def test_registered_words_are_never_excluded(spark, registry):
    good, refused = edits.excludable(spark.createDataFrame([("タロ",), ("柚木",), ("新語",), ("梢田",)], "word string"), registry)
    assert [r["word"] for r in good.collect()] == ["新語"] and sorted(r["word"] for r in refused.collect()) == ["タロ", "柚木"]


def test_aliases(spark):
    book = spark.createDataFrame([("別|利用者|タロ", "", 1, "【利用者001の呼び名1】", "タロ", "タロ", True, False)], codebook.SCHEMA)
    assert edits.alias_collisions(spark.createDataFrame([("莉央", "タロ"), ("莉央", "ハナ")], "person string, alias string"), book).count() == 1
    rows = spark.createDataFrame([(1, ["瑠璃市鈴音町1-2-3", "鈴音ハイツ", "瑠璃市中央4-5"])], "row_no int, aliases array<string>")
    assert sorted(r["address"] for r in edits.address_aliases(rows).collect()) == ["瑠璃市中央4-5", "瑠璃市鈴音町1-2-3　鈴音ハイツ"]


@pytest.mark.parametrize(("f", "yes", "no"), [
    (p.is_han, "柚木", "見ほん"), (p.is_kana, "みホん", "見"), (p.same_digit_run, "000-0000", "0000012"), (p.is_masked, "〇●", "〇本"), (p.has_mask_and_han, "柚〇", "〇〇"), (p.is_organisation, "鈴音クリニック", "朔也"),
    (p.has_counter, "3回", "回"), (p.is_kanji_number, "三回", "三郎"), (p.escape_only, "_x000D_", "a_x000D_"), (p.strong_room, "101号", "101"), (p.room_number, "A-101", "A-10100"), (p.safe_name, "a.docx", "../a"),
    (p.safe_path, "a/b.docx", "a/b/c"), (p.is_placeholder, " なし ", "あり"), (p.is_checkbox, "口", "目"),
])
def test_predicates(spark, f, yes, no):
    assert tuple(spark.range(1).select(f(F.lit(yes)), f(F.lit(no))).first()) == (True, False)


def test_day_records(spark):
    def sheet(name, month="4", day="1", body="本文"):
        values = {"D2": "【利用者001】", "L2": "6", "N2": month, "P2": day, "S2": "月", "C4": "訪問", "A7": body}
        return [(1, name, False, ref, "s", text, None) for ref, text in values.items()]

    rows = sheet("4.1") + sheet("4.1②") + sheet("4.2") + sheet("4.31", day="31") + sheet("表紙") + [(1, "裏", True, "A1", "s", "x", None)]
    cells = spark.createDataFrame(rows, "doc_id long, sheet string, hidden boolean, ref string, type string, text string, formula string")
    got = {r["sheet"]: r for r in forms.day_records(cells).collect()}
    assert {k: r["problem"] for k, r in got.items()} == {"4.1": None, "4.1②": None, "4.2": "sheet name is another day", "4.31": "no date"}
    assert got["4.1②"]["date"] == dt.date(2024, 4, 1) and (got["4.1"]["nth"], got["4.1②"]["nth"]) == (1, 2)
    assert [r["sheet"] for r in forms.newest_days(forms.day_records(cells)).orderBy("place").collect()] == ["4.1②", "4.1"]
    assert [r["sheet"] for r in forms.duplicate_days(forms.day_records(cells).filter("problem is null")).collect()] == ["4.1②"]
    assert forms.recognised(cells, {"C4": "訪問", "A7": "本文"}).count() == 5
    assert [r["text"] for r in forms.hidden_only(cells).collect()] == ["x"]
    assert forms.visible(cells).filter("sheet = '4.1' and row = 2").first()["text"] == "【利用者001】\t6\t4\t1\t月"
    assert forms.first_dates(spark.createDataFrame([(1, "S", "B1", "R6.4.1"), (1, "S", "A1", "x")], "doc_id long, sheet string, ref string, text string"), ("A1", "B1")).first()["date"] == dt.date(2024, 4, 1)


def test_previous_value(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, ""), ("a", 3, None), ("a", 4, "y"), ("b", 1, None)], "owner string, date int, value string")
    assert [r["filled"] for r in forms.previous_value(rows).orderBy("owner", "date").collect()] == ["x", "x", "x", "y", None]

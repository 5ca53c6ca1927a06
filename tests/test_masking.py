"""Masking with a registry, on invented people and places."""

import pytest
from pyspark.sql import functions as F

from veilspark.operators import codebook, mask, names
from veilspark.operators.spans import fold, replaced

REGISTRY = [
    (1, "利用者", "柚木 朔也", ["ユズキ サクヤ"], ""), (2, "家族", "柚木 莉央", [], ""), (3, "家族", "柚木 朔斗", [], ""),
    (4, "住所", "朧月県瑠璃市鈴音町1-2-3", [], ""), (5, "除外", "梢田 美波", [], ""), (6, "その他", "例田", [], ""),
]
SCHEMA = "row_no int, kind string, name string, aliases array<string>, reading string"
UNITS = "doc_id long, part_no int, seq int, text string"


def units(spark, *texts):
    return spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(texts)], UNITS)


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(REGISTRY, SCHEMA)


def masked(spark, registry, *texts, book=None):
    out = names.mask(units(spark, *texts), registry, book if book is not None else codebook.empty(spark))
    return [r["masked"] for r in out.units.orderBy("seq").collect()], out


def test_expected_codes(spark, registry):
    got, _ = masked(
        spark, registry, "柚木 朔也", "フリガナ ユズキ サクヤ", "柚木 莉央と莉央さんが来訪", "〒999-9999 朧月県瑠璃市鈴音町1-2-3 鈴音ハイツ101号", "昭和15年3月2日生まれ", "電話 000-0000-0000、000-1111-2222",
        "被保険者番号 0000012345", "例田さんと面談", "要介護2 鈴音クリニック", "朔斗さんへ連絡",
    )
    assert got == [
        "【利用者001】", "フリガナ 【利用者001の呼び名1】", "【家族001】と【家族001の名】さんが来訪", "【住所001】", "【生年月日001】生まれ", "電話 【電話001】、【電話002】",
        "被保険者番号 【番号001】", "【その他001】さんと面談", "要介護2 鈴音クリニック", "【家族002の名】さんへ連絡",
    ]


def test_round_trip_drops_inner_space_of_names(spark, registry):
    texts = ["柚木 朔也は000-1111-2222へ", "莉央さん", "なし"]
    got, out = masked(spark, registry, *texts)
    back = codebook.restore(out.units.select("doc_id", "part_no", "seq", "masked"), out.delta, "masked").orderBy("seq").collect()
    assert [r["restored"] for r in back] == ["柚木朔也は000-1111-2222へ", "莉央さん", "なし"]
    assert all(not r["unknown"] for r in back)


def test_masking_twice_changes_nothing(spark, registry):
    got, out = masked(spark, registry, "柚木 朔也 000-1111-2222", "0000012345")
    again, _ = masked(spark, registry, *got, book=out.delta)
    assert again == got


def test_codes_stay_when_the_book_grows(spark):
    first = mask.mask(units(spark, "a@b.example と 12345678"), codebook.empty(spark))
    later = mask.mask(units(spark, "c@d.example と a@b.example"), first.delta)
    assert [r["masked"] for r in later.units.collect()] == ["【メール002】 と 【メール001】"]
    assert [(r["orig"], r["n"]) for r in later.delta.collect()] == [("c@d.example", 2)]


def test_unknown_codes_are_reported(spark):
    rows = units(spark, "【利用者009】と【見出し】と【住所001の書き方2】")
    out = codebook.restore(rows, codebook.empty(spark)).first()
    assert out["restored"] == "【利用者009】と【見出し】と【住所001の書き方2】"
    assert set(out["unknown"]) == {"【利用者009】", "【住所001の書き方2】"}


def test_fold_prefers_early_long_and_first_and_keeps_its_place(spark):
    spans = [(5, 3, 1, "b", "x"), (0, 4, 2, "a", "x"), (0, 4, 1, "c", "x"), (3, 2, 0, "d", "x"), (4, 2, 0, "e", "x"), (12, 3, 0, "f", "x")]
    df = spark.createDataFrame([(spans, "0123456789 【a001】")], "s array<struct<st:int,len:int,prio:int,kind:string,orig:string>>, text string")
    assert [r["kind"] for r in df.select(F.explode(fold(F.col("s"), F.col("text"))).alias("s")).select("s.*").collect()] == ["c", "e"]


def test_replaced(spark):
    df = spark.createDataFrame([("abcdef", [(1, 2, "X"), (4, 1, "Y")])], "t string, s array<struct<st:int,len:int,code:string>>")
    assert df.select(replaced(F.col("t"), F.col("s"))).first()[0] == "aXdYf"


def test_digit_boundaries(spark):
    out = mask.find_spans(units(spark, "1000-1111-2222と03-1234-5678、123-45678", "𠮷03-1234-5678"), ("電話", "郵便番号")).orderBy("seq").collect()
    assert [(r["kind"], r["st"], r["orig"]) for r in out] == [("電話", 15, "03-1234-5678"), ("電話", 1, "03-1234-5678")]


def test_large_dictionary_is_joined(spark, registry, monkeypatch):
    texts = ("柚木 朔也と莉央さん", "例田さん", "朧月県瑠璃市鈴音町1-2-3 鈴音ハイツ101号 と瑠璃市本町4-5", "瑠璃市の話", "", None)
    want, _ = masked(spark, registry, *texts)
    monkeypatch.setattr(names, "EXPRESSION_SURFACES", 0)
    got, _ = masked(spark, registry, *texts)
    assert got == want and want[2] == "【住所001】 と瑠璃市本町4-5" and want[4:] == ["", None]


def test_status_and_leftovers(spark):
    rows = units(spark, "a@b.example")
    out = mask.mask(rows, codebook.empty(spark))
    assert codebook.leftovers(out.units, out.delta).count() == 0
    left = codebook.leftovers(out.units.withColumn("masked", F.col("text")), out.delta)
    assert [r["orig"] for r in left.collect()] == ["a@b.example"]
    none = rows.limit(0)
    assert [r["status"] for r in mask.file_status(rows, out.spans, none, none).collect()] == ["ok"]
    assert [r["status"] for r in mask.file_status(rows, out.spans, rows, none).collect()] == ["held"]
    assert [r["status"] for r in mask.file_status(rows, out.spans, rows, left).collect()] == ["err"]


def test_both_dictionary_paths_agree(spark):
    """Random texts over few characters, surfaces that overlap and need something after them."""
    import random

    rng = random.Random(5)
    letters = "田中花さん様アイうえ"
    surfaces = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(40)})
    entries = spark.createDataFrame([(s, ("free", "titled", "housed")[i % 3]) for i, s in enumerate(surfaces)], "surface string, needs string")
    rows = units(spark, "", *["".join(rng.choice(letters) for _ in range(30)) for _ in range(60)])
    span = lambda df: sorted((r["seq"], *(tuple(s) for s in sorted(r["names"]))) for r in df.select("seq", "names").collect())
    one, other = names.name_candidates(rows, entries), names.name_candidates(rows, entries, expression_surfaces=0)
    assert span(one) == span(other)
    text = [r["text"] for r in rows.orderBy("seq").collect()]
    for seq, *found in span(one):
        assert all(text[seq][s[0] : s[0] + s[1]] == s[4] for s in found)
    whole = [n.select("seq", fold(F.col("names"), F.col("text")).alias("n")) for n in (one, other)]
    assert [sorted(map(str, w.collect())) for w in whole][0] == [sorted(map(str, w.collect())) for w in whole][1]

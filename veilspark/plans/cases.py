"""Queries over Japanese texts, registries, workbooks and books of records, which the driver's tables don't have: a
set of documents, books or files for each customer, with the customer's key in its ids and texts. Their SQL
computes the expected rows for each customer. The same cases for one key alone are tests."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address, ocr, predicates
from ..functions import text as tx
from ..functions.patterns import SHAPES, shape_spans
from ..operators import adjacent, cells, codebook, edits, forms, lineage, lookup, names, records, registry, reports, spans, suspect_rules, suspects
from ..sources import ooxml, tables
from ..storage import dealt

UNITS = "doc_id long, part_no int, seq int, text string"
REGISTRY = "row_no int, kind string, name string, aliases array<string>, reading string"
CELLS = "doc_id long, sheet string, hidden boolean, ref string, type string, text string, formula string"
SQL_TYPES = {int: "BIGINT", bool: "BOOLEAN", str: "VARCHAR", float: "DOUBLE"}

#: Of each case its builder and its expected rows, for one key.
CASES: dict[str, tuple[Callable, str]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Ids of different keys are so far apart.
APART = 1000


class Given:
    """Makes frames of a few rows for each customer: ids are moved by the customer's key, and the key stands
    where a text has a tilde. Frames without an id and without a tilde are parameters and stay as they are."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        keys = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey is not null").select(F.col("c_custkey").cast("long").alias("k"))
        self.keys = dealt(keys, "k").distinct()

    def __getattr__(self, name):
        return getattr(self.spark, name)

    def createDataFrame(self, rows: list[tuple], schema: str) -> DataFrame:  # noqa: N802
        fields = self.spark.createDataFrame([], schema).schema.fields
        if "doc_id" not in [f.name for f in fields] and "~" not in repr(rows):
            return self.spark.createDataFrame(rows, schema)

        def value(v, field) -> Column:
            if isinstance(v, list):
                return F.array(*map(F.lit, v)).cast(field.dataType)
            return F.lit(bytes(v) if isinstance(v, bytearray) else v).cast(field.dataType)

        made = F.array(*[F.struct(*[value(v, f).alias(f.name) for v, f in zip(r, fields, strict=True)]) for r in rows])
        out = self.keys.select("k", F.explode(made).alias("r"))
        key = F.col("k").cast("string")
        columns = []
        for f in fields:
            c, kind = F.col("r")[f.name], f.dataType.simpleString()
            if f.name == "doc_id":
                c = (c + F.col("k") * APART).cast("long")
            elif kind == "string":
                c = F.replace(c, F.lit("~"), key)
            elif kind == "array<string>":
                c = F.transform(c, lambda x: F.replace(x, F.lit("~"), key))
            columns.append(c.alias(f.name))
        return out.select(*columns)


class Single:
    """The same frames for one key, without a table."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __getattr__(self, name):
        return getattr(self.spark, name)

    def createDataFrame(self, rows: list[tuple], schema: str) -> DataFrame:  # noqa: N802
        plain = lambda v: v.replace("~", "") if isinstance(v, str) else [plain(x) for x in v] if isinstance(v, list) else v
        return self.spark.createDataFrame([tuple(map(plain, r)) for r in rows], schema)


def literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower()


def expected_sql(columns: tuple[str, ...], rows: list[tuple], by: str | None) -> str:
    """The rows; for each customer, with its key in ids and in place of tildes, if `by` says so."""
    kinds = [next((SQL_TYPES[type(r[i])] for r in rows if r[i] is not None), "VARCHAR") for i in range(len(columns))]
    shown = []
    for c, k in zip(columns, kinds, strict=True):
        cast = f'CAST("{c}" AS {k})'
        if k == "VARCHAR":
            cast = f"replace({cast}, '~', {'CAST(k AS VARCHAR)' if by else repr('')})"
        elif c == "doc_id" and by:
            cast += f" + k * {APART}"
        shown.append(f'{cast} AS "{c}"')
    values = f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({', '.join(f'"{c}"' for c in columns)})"
    if not by:
        return f"SELECT {', '.join(shown)} FROM {values}"
    if by == "doc":
        shown.append(f"1 + k * {APART} AS doc_id")
    return f"SELECT {', '.join(shown)} FROM {values}, (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey IS NOT NULL)"


def case(columns: str, rows: list[tuple], by: str | None = "doc"):
    """Register the function as a query with these result columns and rows for each customer. Whole numbers are
    compared as longs, dates and arrays as text. by: "doc" if the result has the document's id beside the
    columns, "rows" if it is told by the columns alone, None if the case stays a test."""
    wanted = tuple(columns.split())

    def register(build: Callable):
        def shown(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
            kinds, out = dict(df.dtypes), []
            for c in names:
                kind = kinds[c]
                if kind in ("int", "smallint", "tinyint", "bigint"):
                    out.append(F.col(c).cast("long").alias(c))
                else:
                    out.append((F.array_join(c, "|") if kind == "array<string>" else F.col(c).cast("string") if kind == "date" else F.col(c)).alias(c))
            return df.select(*out)

        name = build.__name__
        CASES[name] = (lambda spark: shown(build(Single(spark)), wanted), expected_sql(wanted, rows, None))
        if by:
            told = "doc" if by == "doc" and "doc_id" not in wanted else "rows"
            QUERIES[name] = lambda spark, sf_dir: shown(build(Given(spark, sf_dir)), (*wanted, *(["doc_id"] if told == "doc" else [])))
            ORACLE_SQL[name] = expected_sql(wanted, rows, told)
        return build

    return register


def units(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(texts)], UNITS)


def people(spark: SparkSession) -> DataFrame:
    rows = [(1, "利用者", "柚木 朔也", ["ユズキ サクヤ"], ""), (2, "家族", "柚木 莉央", [], "ゆずき りお"), (3, "家族", "柚木 朔斗", [], ""), (4, "住所", "朧月県瑠璃市鈴音町1-2-3", [], ""), (5, "除外", "梢田 美波", [], ""), (6, "その他", "例田", [], ""), (7, "利用者", "林 実", [], "")]
    return spark.createDataFrame(rows, REGISTRY)


def cell_rows(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame([(1, *r) for r in rows], CELLS)


# --- shapes and addresses

SHAPE_TEXTS = (
    "連絡先は0999-88-7777と03(1234)5678、06 7654 3210", "番号 1234-56-7890 と 01-2-345", "大正9年1月2日、S.30.4.5、1964/7/8", "平成9年1月2日、R5.6.7、1970年3月4日",
    "生年月日： 平成2年3月4日 面談 令和5年6月7日、平成8年9月10日 生まれ", "年齢：81歳（七十）で、(79才)の次に3歳", "〒 123-4567と1234-5678と９９９－１１１１", "12345678と1234567、a.b@c.example",
)


@case("kind seq st orig", [
    ("電話", 0, 4, "0999-88-7777"), ("電話", 0, 17, "03(1234)5678"), ("電話", 0, 30, "06 7654 3210"), ("古い日付", 2, 0, "大正9年1月2日"), ("古い日付", 2, 9, "S.30.4.5"), ("古い日付", 2, 18, "1964/7/8"),
    ("生年月日", 4, 6, "平成2年3月4日"), ("生年月日", 4, 27, "平成8年9月10日"), ("年齢", 5, 3, "81歳"), ("年齢", 5, 13, "79才"), ("郵便番号", 6, 0, "〒 123-4567"), ("郵便番号", 6, 21, "９９９－１１１１"), ("番号", 7, 0, "12345678"), ("メール", 7, 17, "a.b@c.example"),
])
def shapes_of_texts(spark):
    found = F.concat(*[shape_spans(F.col("text"), s) for s in SHAPES])
    return units(spark, *SHAPE_TEXTS).select("doc_id", "seq", F.explode(found).alias("s")).select("doc_id", "s.kind", "seq", "s.st", "s.orig")


@case("seq orig", [
    (0, "埼玉県ふじみ野市上福岡7-8-9"), (1, "うるま市石川2-40-1"), (2, "伊豆の国市韮山12-3"), (3, "朧月県あおぞら村東3番地"), (4, "千葉県いすみ市岬町九丁目10番11号"), (5, "月影市くすのき台8-1-2"),
    (6, "月影市ゆりの木3丁目2番地の5"), (7, "月影市うぐいすが森6-6"), (8, "月影市本町2-3"), (9, "月影市はやぶさ11-12-13"),
])
def addresses_of_texts(spark):
    texts = ("兄の家は埼玉県ふじみ野市上福岡7-8-9です。", "転居先 うるま市石川2-40-1", "送り先：伊豆の国市韮山12-3", "朧月県あおぞら村東3番地", "千葉県いすみ市岬町九丁目10番11号へ送付", "（月影市くすのき台8-1-2）", "実家は月影市ゆりの木3丁目2番地の5", "月影市うぐいすが森6-6", "横町市から月影市本町2-3へ移った", "月影市はやぶさ11-12-13")
    none = ("月影市には5-6年いた。", "月影市へ7-8名で行く。", "月影市などで4-5か所を見た。", "あの町を3-4周した", "月影市と横町市が6-7位", "本市さまへ1-2件", "丘の上で2-3日")
    return units(spark, *texts, *none).select("doc_id", "seq", F.explode(address.address_spans(F.col("text"))).alias("s")).select("doc_id", "seq", "s.orig")


@case("seq st len core", [(0, 3, 34, "瑠璃市鈴音町1-2-3"), (1, 0, 14, "瑠璃市鈴音町1-2-3")])
def address_lumps_of_texts(spark):
    rows = units(spark, "住所 〒999-9999 朧月県瑠璃市鈴音町１－２－３ 鈴音ハイツ101号 他", "朧月県瑠璃市鈴音町1-2-3", "瑠璃市の話")
    return rows.select("doc_id", "seq", F.explode(address.address_lumps(F.col("text"))).alias("l")).select("doc_id", "seq", "l.*")


# --- masking

MASK_TEXTS = ("柚木 朔也", "フリガナ ユズキ サクヤ", "柚木 莉央と莉央さんが来訪", "〒999-9999 朧月県瑠璃市鈴音町1-2-3 鈴音ハイツ101号", "昭和15年3月2日生まれ", "電話 000-0000-0000、000-1111-2222", "被保険者番号 0000012345", "例田さんと面談", "要介護2 鈴音クリニック", "朔斗さんへ連絡", "梢田 美波")
MASKED = ["【利用者001】", "フリガナ 【利用者001の呼び名1】", "【家族001】と【家族001の名】さんが来訪", "【住所001】", "【生年月日001】生まれ", "電話 【電話001】、【電話002】", "被保険者番号 【番号001】", "【その他001】さんと面談", "要介護2 鈴音クリニック", "【家族002の名】さんへ連絡", "梢田 美波"]


@case("seq masked", list(enumerate(MASKED)))
def masking_with_registry(spark):
    return names.mask(units(spark, *MASK_TEXTS), people(spark), codebook.empty(spark)).units


@case("seq restored unknown", [(0, "柚木朔也は000-1111-2222へ", ""), (1, "莉央さん", ""), (2, "なし", ""), (3, "【利用者999】と【未知】", "【利用者999】")])
def restoring_with_book(spark):
    out = names.mask(units(spark, "柚木 朔也は000-1111-2222へ", "莉央さん", "なし", "【利用者999】と【未知】"), people(spark), codebook.empty(spark))
    return codebook.restore(out.units.select("doc_id", "part_no", "seq", "masked"), out.delta, "masked")


@case("seq orig", [(0, "柚木 朔也"), (1, "a1@b.example"), (2, "12345678"), (3, "瑠璃市鈴音町1-2-3")])
def leftovers_of_texts(spark):
    book = spark.createDataFrame([("型|番号|12345678", "番号", 1, "【番号001】", "12345678", "12345678", False, False), ("型|番号|00000000", "番号", 2, "【番号002】", "00000000", "00000000", False, False)], codebook.SCHEMA)
    rows = units(spark, "柚木 朔也が来た", "x a1@b.example", "登録A12345678号", "朧月県瑠璃市鈴音町1-2-3", "00000000", "【利用者001】")
    return codebook.leftovers(rows, book, "text", people(spark))


@case("surface space needs", [("林", "姓", "titled"), ("実", "下", "titled"), ("林実", "名", "free"), ("林 実", "名", "free"), ("林　実", "名", "free")], by=None)
def dictionary_surfaces(spark):
    return registry.dictionary(people(spark).filter("row_no = 7"))


@case("seq kind text", [(0, "plain", "連絡は"), (0, "電話", "000-1111-2222"), (0, "plain", "まで"), (1, "plain", "なし")])
def segments_of_texts(spark):
    found = spans.fold(shape_spans(F.col("text"), next(s for s in SHAPES if s.kind == "電話")), F.col("text"))
    return units(spark, "連絡は000-1111-2222まで", "なし").select("doc_id", "seq", F.explode(spans.segments(F.col("text"), found)).alias("p")).select("doc_id", "seq", "p.kind", "p.text")


# --- suspects

RULES = {
    "honoured": (suspects.honoured, ("例田さんと同様に対応", "ご家族様へ", "模様を確認", "みほちゃん", "ミナミ先生の様子"), [(0, "例田さん"), (3, "みほちゃん"), (4, "ミナミ先生")]),
    "address": (suspects.unregistered_addresses, ("転居先は月影市本町2-3 鈴音ハイツ101号", "週に2-3回"), [(0, "月影市本町2-3 鈴音ハイツ101号")]),
    "label": (suspects.labelled_names, ("氏名： 例田 次郎", "氏名の欄"), [(0, "例田 次郎")]),
    "birth": (suspects.leftover_dates, ("生年月日：平成2年3月4日", "面談 平成2年3月4日"), [(0, "平成2年3月4日")]),
    "unhonoured": (suspects.unhonoured, ("梢田 美波", "朝 昼 夕の薬"), [(0, "梢田 美波")]),
    "date": (suspects.beside_dates, ("令和5年6月7日 例田", "令和5年6月7日 例田が来所"), [(0, "例田")]),
    "after label": (suspects.after_label, ("氏名：", "例田 次郎", "備考", "例田 次郎", "電話", "12-34"), [(1, "例田 次郎"), (5, "12-34")]),
    "glued label": (suspect_rules.glued_labels, ("利用者名例田次郎 様", "利用者名簿"), [(0, "例田次郎")]),
    "nurse": (suspect_rules.beside_nurses, ("例田Nsに報告", "担当看護師", "看護師：梢田、確認"), [(0, "例田"), (2, "梢田")]),
    "kana ko": (suspect_rules.kana_with_ko, ("よし子さん来所", "椅子さん", "帽子を"), [(0, "よし子さん")]),
    "field": (suspect_rules.fields_in_text, ("住所：鈴音1の2", "住所：変更なし", "フリガナ：ユズキ サクヤ"), [(0, "鈴音1の2"), (2, "ユズキ サクヤ")]),
    "dashed lot": (suspect_rules.dashed_lots, ("鈴音町1-2-3に転居", "電話03-1234-5678", "3-4回"), [(0, "鈴音町1-2-3")]),
    "contact": (suspect_rules.contact_labels, ("緊急連絡先：梢田 美波", "長男（例田次郎）", "連絡先：長男"), [(0, "梢田 美波"), (1, "例田次郎")]),
    "kin": (suspect_rules.kin_with_names, ("長女の梢田 美波", "長女の手を"), [(0, "梢田 美波")]),
    "given": (suspect_rules.given_after_codes, ("【家族001】次郎、来所", "【家族001】様", "【利用者001】訪問"), [(0, "次郎")]),
    "era date": (suspect_rules.wide_era_dates, ("昭和１５年３月", "平成2年3月"), [(0, "昭和１５年３月")]),
    "job": (suspect_rules.jobs_with_names, ("看護師の高橋、記録", "例田さん", "主任：例田", "医師の指示"), [(0, "高橋"), (2, "例田")]),
    "building": (suspect_rules.building_after_codes, ("【住所001】鈴音ハイツ101", "【住所001】へ"), [(0, "鈴音ハイツ101")]),
    "dated": (suspect_rules.dated_names, ("令和5年6月7日 例田 訪問", "令和5年6月7日 本人 訪問"), [(0, "例田")]),
    "garbled": (suspect_rules.garbled_names, ("例〓さんに電話", "例さん?"), [(0, "例〓さん")]),
    "stuck": (suspect_rules.beside_codes, ("木【利用者001】へ", "夫【利用者001】へ"), [(0, "木")]),
}


@case("detector seq word", [(name, seq, word) for name, (_, _, rows) in RULES.items() for seq, word in rows])
def suspects_by_rule(spark):
    found = [rule(units(spark, *texts)).select("doc_id", F.lit(name).alias("detector"), "seq", "word") for name, (rule, texts, _) in RULES.items()]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


@case("seq word", [(0, "柚本朔也"), (2, "例田 次郎")])
def suspects_of_units(spark):
    rows = units(spark, "柚本朔也が来所", "梢田 美波", "例田 次郎", "【利用者001】様")
    return suspects.find(rows, registry.exclusions(people(spark)), spark.createDataFrame([("柚木朔也",)], "surface string"))


@case("word", [("柚木朔也",), ("莉央",)])
def merged_suspects(spark):
    rows = [(1, 0, 0, 0, 0, "a", "朔也さん", "", ""), (1, 0, 0, 1, 0, "b", "柚木朔也", "", ""), (1, 0, 0, 2, 5, "c", "木朔", "", ""), (1, 0, 0, 3, 9, "d", "莉央", "", "")]
    return suspects.merge_contained(spark.createDataFrame(rows, "doc_id long, part_no int, seq int, prio int, st int, rule string, word string, context string, reason string"))


@case("doc_id", [(1,)])
def drug_documents_of_units(spark):
    rows = [(1, 0, 0, "処方 内服 5mg 1錠 食後"), (1, 0, 1, "薬局 用法"), (2, 0, 0, "食後に散歩"), (3, 0, 0, "処方 内服 薬局 用法")]
    return suspects.drug_documents(spark.createDataFrame(rows, UNITS))


@case("reason category", [("name: before a title", "name"), ("address: down to the lot", "addr"), ("entry of a field", "other"), ("name: behind a job", "name")])
def suspect_categories(spark):
    df = spark.createDataFrame([(1, "name: before a title"), (1, "address: down to the lot"), (1, "entry of a field"), (1, "name: behind a job")], "doc_id long, reason string")
    return df.withColumn("category", suspects.category(F.col("reason")))


@case("core word n", [("a【】b", "柚木朔也", 2), ("c", "朔也", 1)])
def suspect_boxes(spark):
    return adjacent.boxes(spark.createDataFrame([(1, "朔也", "a【x001】b"), (1, "柚木朔也", "a【y002】b"), (1, "朔也", "c")], "doc_id int, word string, context string"))


# --- neighbours and people of a document


@case("seq st orig", [(1, 1, "昭和15年3月2日")])
def births_after_labels(spark):
    return adjacent.birth_dates_after_label(units(spark, "生年月日：", " 昭和15年3月2日 生", "昭和1年1月1日"))


@case("seq base_code orig", [(1, "【住所001】", "鈴音ハイツ101号")])
def addresses_that_go_on(spark):
    return adjacent.address_continuations(units(spark, "住所 【住所001】", "鈴音ハイツ101号", "次").withColumnRenamed("text", "masked"))


@case("seq orig", [(0, "林"), (1, "林"), (4, "林"), (5, "実")])
def single_character_names(spark):
    rows = units(spark, "林", "【利用者001の名】 林", "森林", "林業", "林様", "実 【利用者001】").withColumnRenamed("text", "masked")
    return adjacent.single_characters(rows, people(spark).filter("row_no = 7"))


@case("doc_id surname person", [(1, "柚木", "柚木朔也")])
def sole_bearers_of_surnames(spark):
    found = spark.createDataFrame([(1, "名", "利用者", "柚木朔也"), (2, "名", "利用者", "柚木朔也"), (2, "名", "家族", "柚木莉央")], "doc_id long, space string, kind string, person string")
    return adjacent.sole_bearers(found, spark.createDataFrame([("柚木朔也", "柚木"), ("柚木莉央", "柚木")], "person string, surname string"))


@case("doc_id surface person", [(1, "莉央", "柚木莉央"), (2, "莉央", "柚木莉央")])
def preferred_people(spark):
    found = spark.createDataFrame([(1, "名", "利用者", "柚木朔也"), (2, "名", "利用者", "柚木朔也"), (2, "名", "家族", "柚木莉央")], "doc_id long, space string, kind string, person string")
    owners = spark.createDataFrame([("莉央", "柚木莉央", "家族"), ("莉央", "例田莉央", "家族")], "surface string, person string, kind string")
    return adjacent.preferred(found, owners, spark.createDataFrame([("柚木朔也", "柚木"), ("柚木莉央", "柚木"), ("例田莉央", "例田")], "person string, surname string"))


@case("seq reading person", [(0, "ユズキ サクヤ", "柚木朔也")])
def readings_near_people(spark):
    return adjacent.readings_of_people(units(spark, "フリガナ ユズキ サクヤ", "氏名"), spark.createDataFrame([(1, 1, "柚木朔也")], "doc_id long, seq int, person string"))


@case("seq person", [(0, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b"), (6, "b"), (7, "b")])
def nearest_people(spark):
    return registry.nearest_person(spark.createDataFrame([(1, i) for i in range(8)], "doc_id int, seq int"), spark.createDataFrame([(1, 2, "a"), (1, 4, "b")], "doc_id int, seq int, person string"))


@case("doc_id users", [(1, "【利用者001】|【利用者002】")])
def users_of_texts(spark):
    return adjacent.users_of_documents(units(spark, "【利用者002】と【利用者001の名】", "【家族001】").withColumnRenamed("text", "masked"))


@case("job state at", [("j~", "済", 4), ("j~", "済", 3), ("j~", "未", 2), ("j~", "未", 1)], by="rows")
def work_board(spark):
    rows = [("j~", "済", i) for i in range(5)] + [("j~", "未", i) for i in range(3)]
    return adjacent.board(spark.createDataFrame(rows, "job string, state string, at int"), done=2, log=2)


# --- the registry


@case("word person", [("柚〇朔也", "柚木朔也"), ("●央", "柚木莉央")], by=None)
def owners_of_hidden_names(spark):
    return registry.masked_owners(spark.createDataFrame([("柚〇朔也",), ("●央",), ("〇〇",), ("例〇次郎",)], "word string"), people(spark))


@case("word surface at", [("柚本朔也~・~", "柚木朔也~・~", 1)], by="rows")
def near_registered_names(spark):
    words = spark.createDataFrame([("柚本朔也~・~",), ("柚木朔也~・~",), ("柚木朔~・~",), ("袖本朔也~・~",)], "word string")
    return registry.near_names(words, spark.createDataFrame([("柚木朔也~・~",)], "surface string"))


@case("code person", [("【家族00~の名】", "柚木莉央")], by="rows")
def owners_of_codes(spark):
    book = spark.createDataFrame([("下|家族|柚木莉央", "の名", 0, "【家族00~の名】", "柚木莉央", "莉央", True, False)], codebook.SCHEMA)
    return adjacent.token_owners(spark.createDataFrame([("【家族00~の名】",), ("【家族009】",)], "code string"), book, people(spark))


NEW_ROWS = [("利用者", "柚木朔也", [], ""), ("家族", "例 莉央", [], ""), ("家族", "例莉央", [], ""), ("家族", "なし", [], ""), ("家族", "  ", [], "")]
NEW = "kind string, name string, aliases array<string>, reading string"


@case("name reason", [("柚木朔也", "exists"), ("例 莉央", "given twice"), ("なし", "placeholder"), ("  ", "blank")], by=None)
def refused_rows(spark):
    return edits.added(people(spark), spark.createDataFrame(NEW_ROWS, NEW))[1]


@case("row_no name", [(8, "例 莉央")], by=None)
def added_rows(spark):
    return edits.added(people(spark), spark.createDataFrame(NEW_ROWS, NEW))[0].filter("row_no > 7")


@case("row_no name", [(1, "柚木 次郎"), (5, "梢田 美波")], by=None)
def changed_rows(spark):
    rows = [(1, "利用者", "柚木 朔也", "利用者", "柚木 次郎", [], ""), (5, "除外", "別", "除外", "x", [], ""), (6, "その他", "例田", None, None, None, None)]
    seen = spark.createDataFrame(rows, "row_no int, old_kind string, old_name string, kind string, name string, aliases array<string>, reading string")
    return edits.changed(people(spark), seen)[0].filter("row_no in (1, 5, 6)")


@case("word refused", [("新語", False), ("柚木", True)], by=None)
def excludable_words(spark):
    good, refused = edits.excludable(spark.createDataFrame([("柚木",), ("新語",), ("梢田美波",)], "word string"), people(spark))
    return good.filter("word <> '梢田美波'").select("word", F.lit(False).alias("refused")).unionByName(refused.select("word", F.lit(True).alias("refused")))


@case("person alias", [("莉央~", "タロ~")], by="rows")
def alias_collisions(spark):
    book = spark.createDataFrame([("別|利用者|タロ~", "", 1, "【利用者001の呼び名1】", "タロ~", "タロ~", True, False)], codebook.SCHEMA)
    return edits.alias_collisions(spark.createDataFrame([("莉央~", "タロ~"), ("莉央~", "ハナ~")], "person string, alias string"), book)


@case("row_no address", [(1, "瑠璃市鈴音町1-2-3　鈴音ハイツ"), (1, "瑠璃市中央4-5")], by=None)
def address_aliases(spark):
    return edits.address_aliases(spark.createDataFrame([(1, ["瑠璃市鈴音町1-2-3", "鈴音ハイツ", "瑠璃市中央4-5"])], "row_no int, aliases array<string>"))


# --- lookups and lineage


@case("name level reason", [("柚木朔也~", "要介護2", None), ("柚木莉央~", None, "ambiguous"), ("無名~", None, "not found")], by="rows")
def certificates_by_name(spark):
    d = dt.date
    certs = spark.createDataFrame([("柚木 朔也~", "要介護1", d(2020, 1, 1), d(2021, 1, 1)), ("柚木朔也~", "要介護2", d(2024, 1, 1), d(2025, 1, 1))], "name string, level string, start date, end date")
    persons = spark.createDataFrame([("柚木　朔也~", "ゆずきたろう", "1940-01-01", "x"), ("柚木莉央~", "ア", "1", "x"), ("柚木莉央~", "イ", "1", "x")], "name string, kana string, birth string, address string")
    return lookup.find(spark.createDataFrame([("柚木朔也~",), ("柚木莉央~",), ("無名~",)], "name string"), persons, certs, F.lit("2025-01-01").cast("date"))


@case("item include reason", [("p1", True, None), ("p2", False, "shared source"), ("s1", True, None), ("r1", False, "shared report")], by=None)
def cleaning_plan(spark):
    rows = [("M", "p1", "ok", "s1", "r1"), ("M", "p2", "ok", "s1", "r1"), ("M", "p2", "ok", "s2", "r2"), ("S", "s1", None, None, "j1"), ("S", "s2", None, None, "j2")]
    ledger = spark.createDataFrame([(k, None, *r) for k, *r in rows], "kind string, at timestamp, h1 string, status string, h2 string, ref string")
    return lineage.clean_plan(ledger, "j1")


@case("doc_id reason", [(1, "unprocessed sources"), (2, "registered word left"), (3, "no user found"), (4, "other user"), (5, "mixed users"), (6, None), (7, "suspect in note")])
def gate_before_sending(spark):
    rows = [(1, 1, 0, ["u"], "u", 0, False), (2, 0, 1, ["u"], "u", 0, False), (3, 0, 0, [], "u", 0, False), (4, 0, 0, ["v"], "u", 0, False), (5, 0, 0, ["u", "v"], "u", 0, False), (6, 0, 0, ["u", "v"], "u", 0, True), (7, 0, 0, ["u"], "u", 1, False)]
    return lineage.send_gate(spark.createDataFrame(rows, "doc_id int, pending int, registered int, users array<string>, chosen string, suspects int, confirmed boolean"))


# --- workbooks and books of records


@case("ref round", [("A1", 0), *((f"A{i}", i - 1) for i in range(2, 8))])
def formulas_of_registered_cells(spark):
    rows = [("S", False, "A1", "n", "1", None), *(("S", False, f"A{i}", "n", "", f"=$A${i - 1}+'T x'!B2") for i in range(2, 11)), ("T x", False, "B2", "s", "秘密", None)]
    return cells.registered(cell_rows(spark, *rows), spark.createDataFrame([("S", "A1", "氏名")], "sheet string, ref string, label string"))


@case("text distance", [("右", 2), ("下", 2)])
def cells_beside_labels(spark):
    rows = [("S", False, r, "s", t, None) for r, t in (("B2", "生年月日："), ("D2", "右"), ("B4", "下"), ("A1", "外"), ("C3", "斜"))]
    return cells.beside_label(cells.addressed(cell_rows(spark, *rows)))


@case("ref", [("A1",), ("B2",), ("C3",)], by="rows")
def configured_cells(spark):
    return cells.target_list(spark.createDataFrame([("S~", "氏名", "$A$1、B2 C3"), ("#S~", "x", "D4")], "sheet string, label string, cells string"))


@case("ref", [("A1",)])
def long_number_cells(spark):
    rows = [("S", False, r, "n", t, None) for r, t in (("A1", "1234567890"), ("A2", "1234567"), ("A3", "99999999"))]
    return cells.long_numbers(cell_rows(spark, *rows), spark.createDataFrame([("99999999",)], "word string"))


def _days(spark) -> DataFrame:
    def sheet(name, day="1", body="本文"):
        values = {"D2": "【利用者001】", "L2": "6", "N2": "4", "P2": day, "S2": "月", "C4": "訪問", "A7": body}
        return [(name, False, ref, "s", text, None) for ref, text in values.items()]

    return cell_rows(spark, *sheet("4.1"), *sheet("4.1②"), *sheet("4.2"), *sheet("4.31", day="31"), ("裏", True, "A1", "s", "x", None))


@case("sheet date nth problem", [("4.1", "2024-04-01", 1, None), ("4.1②", "2024-04-01", 2, None), ("4.2", "2024-04-01", 1, "sheet name is another day"), ("4.31", None, 1, "no date")])
def records_of_days(spark):
    return forms.day_records(_days(spark))


@case("sheet place", [("4.1②", 1), ("4.1", 2)])
def newest_records(spark):
    return forms.newest_days(forms.day_records(_days(spark)))


@case("text", [("x",)])
def hidden_texts(spark):
    return forms.hidden_only(_days(spark))


@case("owner date filled", [("a~", 1, "x"), ("a~", 2, "x"), ("a~", 3, "x"), ("a~", 4, "y"), ("b~", 1, None)], by="rows")
def filled_forms(spark):
    return forms.previous_value(spark.createDataFrame([("a~", 1, "x"), ("a~", 2, ""), ("a~", 3, None), ("a~", 4, "y"), ("b~", 1, None)], "owner string, date int, value string"))


@case("date sort_key continuation", [("2024-04-01", "20240401-02", 0), (None, "20240401-02", 1)], by="rows")
def index_rows(spark):
    return records.list_rows(spark.createDataFrame([(dt.date(2024, 4, 1), 2, "訪問", ["x~", "y"])], "day date, nth int, kind string, paras array<string>"))


@case("name free", [("4.1", "4.1③"), ("4.2", "4.2")], by="rows")
def free_sheet_names(spark):
    want = spark.createDataFrame([("b~", "4.1"), ("b~", "4.2")], "book string, name string")
    return records.free_names(want, spark.createDataFrame([("b~", "4.1"), ("b~", "4.1②")], "book string, name string"))


@case("page row text", [(1, 1, "氏名　柚木"), (1, 2, "次"), (2, 1, "裏")])
def rows_of_scans(spark):
    lines = ["#PAGE 1", "10\t50\t12\t柚木", "12\t5\t12\t氏名", "40\t5\t12\t次", "#PAGE 2", "5\t5\t10\t裏"]
    return records.ocr_rows(records.ocr_lines(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, n int, line string")))


@case("fixed", [("柚木さん 03-1234-5678 と BOOK",)])
def repaired_scans(spark):
    df = spark.createDataFrame([(1, "柚 木 さ ん O3-l234-5678 と BOOK")], "doc_id long, t string")
    return df.select("doc_id", ocr.repaired(ocr.joined_wide(F.col("t"))).alias("fixed"))


# --- reports


@case("word surface", [("髙﨑朔也~", "高崎朔也~"), ("渡邊~", "渡辺~")], by="rows")
def names_in_other_glyphs(spark):
    words = spark.createDataFrame([("髙﨑朔也~",), ("渡邊~",), ("渡辺~",), ("例田~",)], "word string")
    return reports.variant_names(words, spark.createDataFrame([("高崎朔也~",), ("渡辺~",)], "surface string"))


@case("seq orig owner", [(0, "昭和15年3月2日", "柚木朔也"), (1, "1940/3/2", "柚木朔也"), (2, "S15.3.2", "柚木朔也")])
def registered_dates_in_any_spelling(spark):
    dates = spark.createDataFrame([(dt.date(1940, 3, 2), "柚木朔也")], "date date, owner string")
    return reports.registered_dates(units(spark, "生 昭和15年3月2日", "1940/3/2生", "S15.3.2", "昭和15年3月3日"), dates)


@case("seq surface label", [(1, "鈴音クリニック", "医院")])
def workbook_names_in_texts(spark):
    rows = [("S", False, "A1", "s", "鈴音 クリニック", None), ("S", False, "A2", "n", "1234", None), ("S", False, "A3", "s", "他", None)]
    found = spark.createDataFrame([(1, "S", "A1", "医院"), (1, "S", "A2", "番号"), (1, "S", "A3", "x")], "doc_id long, sheet string, ref string, label string")
    return reports.later_mentions(units(spark, "他の医院", "鈴音クリニックへ"), reports.workbook_names(cell_rows(spark, *rows), found))


@case("category n place", [("addr", 1, 1), ("name", 2, 2)])
def suspects_by_category(spark):
    rows = [(1, 0, 3, 0, "name: before a title"), (1, 0, 1, 0, "address: down to the lot"), (1, 0, 2, 5, "name: in a name field")]
    return reports.suspect_counts(spark.createDataFrame(rows, "doc_id long, part_no int, seq int, st int, reason string"))


@case("kind n registered place", [("メール", 1, False, 1), ("氏名", 2, True, 2)], by=None)
def guides_of_leftovers(spark):
    return reports.leftover_guides(spark.createDataFrame([("氏名", 2, False), ("メール", 1, False), ("氏名", 3, True)], "kind string, at int, registered boolean"))


@case("row_no code n_same", [(1, "【利用者00~】", 1), (2, None, 2), (3, None, 2)], by="rows")
def registry_with_codes(spark):
    rows = spark.createDataFrame([(1, "利用者", "柚木 朔也~", [], ""), (2, "家族", "柚木 莉央~", [], ""), (3, "家族", "柚木莉央~", [], "")], REGISTRY)
    book = spark.createDataFrame([("名|利用者|柚木朔也~", "利用者", 1, "【利用者00~】", "柚木朔也~", "柚木朔也~", True, False)], codebook.SCHEMA)
    return reports.rows_with_codes(rows, book)


@case("added", [("ハナ~",)], by="rows")
def aliases_that_are_new(spark):
    return reports.new_aliases(spark.createDataFrame([(["柚木 莉央~"], ["柚木莉央~", "ハナ~"])], "old array<string>, target array<string>"))


@case("dir from to n", [("d~", "a", "x", 2), ("d~", "b", "x", 2), ("d~", "c", "z", 2)], by="rows")
def colliding_renames(spark):
    rows = [("d~", "a", "x"), ("d~", "b", "x"), ("d~", "c", "z"), ("d~", "z", "z"), ("e~", "a", "x"), ("e~", "y", "y")]
    return reports.rename_collisions(spark.createDataFrame(rows, "dir string, from string, to string"))


@case("user name", [("u~", "2024-04-01_3"), ("v~", "2024-04-01")], by="rows")
def names_of_new_jobs(spark):
    wanted = spark.createDataFrame([("u~", dt.date(2024, 4, 1)), ("v~", dt.date(2024, 4, 1))], "user string, day date")
    return reports.free_job_names(wanted, spark.createDataFrame([("u~", "2024-04-01"), ("u~", "2024-04-01_2")], "user string, name string"))


@case("job n", [("j2~", 2)], by="rows")
def jobs_without_results(spark):
    rows = [("S", "s1~", None, "j1~"), ("S", "s2~", None, "j2~"), ("S", "s3~", None, "j2~"), ("R", "r1~", "j1~", "x")]
    return reports.unfinished_jobs(spark.createDataFrame(rows, "kind string, h1 string, h2 string, ref string"))


@case("doc_id n_units n_unknown unknown", [(1, 1, 2, "【家族009】|【番号009】"), (2, 0, 0, "")])
def counts_of_restoring(spark):
    rows = [(1, "【利用者001】", "柚木", ["【番号009】"]), (1, "x", "x", ["【家族009】"]), (2, "y", "y", [])]
    return reports.restored_counts(spark.createDataFrame(rows, "doc_id long, text string, restored string, unknown array<string>"))


@case("date nth body is_new row", [("2024-04-03", 1, "n", True, 1), ("2024-04-02", 1, "r", True, 2), ("2024-04-01", 1, "a", False, 3)], by="rows")
def records_inserted_into_books(spark):
    schema = "book string, date date, nth int, body string"
    book = spark.createDataFrame([("b~", dt.date(2024, 4, 1), 1, "a"), ("b~", dt.date(2024, 4, 2), 1, "o")], schema)
    return reports.inserted_newest_first(book, spark.createDataFrame([("b~", dt.date(2024, 4, 3), 1, "n"), ("b~", dt.date(2024, 4, 2), 1, "r")], schema))


@case("body nth sheet", [("x", 2, "4.1②"), ("y", 3, "4.1③"), ("z", 1, "4.2")], by="rows")
def sheets_of_new_records(spark):
    book = spark.createDataFrame([("b~", dt.date(2024, 4, 1), 1, "a")], "book string, date date, nth int, body string")
    new = spark.createDataFrame([("b~", dt.date(2024, 4, 1), "x"), ("b~", dt.date(2024, 4, 1), "y"), ("b~", dt.date(2024, 4, 2), "z")], "book string, date date, body string")
    return reports.next_in_day(book, new)


# --- sources


def _package() -> bytearray:
    return bytearray(ooxml.simple_document("題", ["柚木 朔也 & 莉央", "次"]))


@case("doc_id seq text err", [(7, 0, "題", None), (7, 1, "【利用者001】 <x>", None), (7, 2, "次", None), (8, 0, None, "BadZipFile: File is not a zip file")])
def rewritten_packages(spark):
    files = spark.createDataFrame([(7, _package())], "doc_id long, content binary")
    new = ooxml.rewritten_documents(files, spark.createDataFrame([(7, 1, "【利用者001】 <x>")], "doc_id long, seq int, text string"))
    return ooxml.document_units(new.unionByName(spark.createDataFrame([(8, bytearray(b"no zip"))], "doc_id long, content binary")))


def _workbook() -> bytearray:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="表" sheetId="1" r:id="r1"/><sheet name="裏" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>柚木</t><rPh sb="0" eb="2"><t>ユズキ</t></rPh></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><f t="shared" si="0" ref="B1:B2">A1+$A$1</f><v>1</v></c></row><row r="2"><c r="B2"><f t="shared" si="0"/><v>2</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>隠</t></is></c></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return bytearray(out.getvalue())


@case("doc_id sheet hidden ref type text formula", [
    (1, "表", False, "A1", "s", "柚木", None), (1, "表", False, "B1", "n", "1", "A1+$A$1"), (1, "表", False, "B2", "n", "2", "A2+$A$1"), (1, "裏", True, "A1", "inlineStr", "隠", None),
    (2, "表", False, "A1", "inlineStr", "【利用者001】", None), (2, "表", False, "B1", "n", "1", "A1+$A$1"), (2, "表", False, "B2", "n", "2", "A2+$A$1"), (2, "裏", True, "A1", "inlineStr", "隠", None),
])
def rewritten_workbooks(spark):
    files = spark.createDataFrame([(1, _workbook()), (2, _workbook())], "doc_id long, content binary")
    return ooxml.workbook_cells(ooxml.rewritten_workbooks(files, spark.createDataFrame([(2, "表", "A1", "【利用者001】")], "doc_id long, sheet string, ref string, text string")))


def _nested() -> bytearray:
    """A paragraph with a tab stop, a hidden run and a text box, and a package inside the package."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    box = "<w:r><w:pict><w:txbxContent><w:p><w:r><w:t>箱</w:t></w:r></w:p></w:txbxContent></w:pict></w:r>"
    body = f'<w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>見</w:t><w:tab/></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>隠</w:t></w:r>{box}</w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/embeddings/inner.docx", ooxml.simple_document("中", []))
    return bytearray(out.getvalue())


@case("seq part text visible_text visible", [(0, "word/document.xml", "見\t隠", "見\t", True), (1, "word/document.xml", "箱", "箱", True), (2, "word/embeddings/inner.docx!word/document.xml", "中", "中", True)])
def nested_packages(spark):
    return ooxml.document_units(spark.createDataFrame([(1, _nested())], "doc_id long, content binary"))


@case("seq text", [(0, "見\t隠"), (1, "【箱】"), (2, "【中】")])
def rewritten_nested_packages(spark):
    files = spark.createDataFrame([(1, _nested())], "doc_id long, content binary")
    return ooxml.document_units(ooxml.rewritten_documents(files, spark.createDataFrame([(1, 1, "【箱】"), (1, 2, "【中】")], "doc_id long, seq int, text string")))


@case("path n encoding cells reason", [
    ("a~", 0, "cp932", "氏名|生年月日", None), ("a~", 1, "cp932", "柚木 朔也|昭和15年3月2日|余り", None), ("b~", 0, "utf-8-sig", "氏名|開始日", None), ("b~", 1, "utf-8-sig", "x|2", None), ("c~", 0, None, None, "too large"),
], by="rows")
def delimited_files(spark):
    contents = {"a~": "氏名;生年月日\n柚木 朔也;昭和15年3月2日;余り\n\n;\n".encode("cp932"), "b~": b"\xef\xbb\xbf" + "氏名\t開始日\nx\t2\n".encode(), "c~": b"x" * 500}
    return tables.delimited(spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in contents.items()], "path string, bytes long, content binary"), most_bytes=400)


@case("row_no kind name aliases reading", [(1, "人物", "柚木 朔也", "a|b", "ゆずき")], by="rows")
def registry_rows(spark):
    rows = [("p~", 0, "utf-8", ["区分", "氏名", "呼び名", "フリガナ"]), ("p~", 1, "utf-8", ["", "柚木 朔也", "a/b", "ゆずき"]), ("p~", 2, "utf-8", ["家族", ""])]
    return tables.registry_of(spark.createDataFrame(rows, "path string, n int, encoding string, cells array<string>"))


# --- functions

FUNCTIONS = {
    "norm_name": (tx.norm_name, "柚木 朔　也", "柚木朔也"), "clean_name": (tx.clean_name, " 柚木 　朔也 ", "柚木 朔也"), "half_digits": (tx.half_digits, "Ｒ６．１", "R6.1"), "half_width": (tx.half_width, "ａＢ １", "AB1"),
    "hiragana": (tx.hiragana, "ユズキ", "ゆずき"), "katakana": (tx.katakana, "ゆずき", "ユズキ"), "mask_key": (tx.mask_key, "柚●朔＊", "柚〇朔〇"), "sanitize_prefix": (tx.sanitize_prefix, "利用者 1【x】", "利用者x"), "sanitize_empty": (tx.sanitize_prefix, "【1】", "人物"),
    "addr_norm": (tx.addr_norm, "瑠璃市１－２ ３", "瑠璃市1-23"), "addr_canon": (tx.addr_canon, "〒999-9999朧月県瑠璃市1-2", "瑠璃市1-2"), "clean_alias": (tx.clean_alias, "a/ b、a,,c", "a／b／c"), "truncated": (lambda c: tx.truncated(c, 2), "柚木朔", "柚木…"), "one_line": (tx.one_line, "a\r\nb", "a／b"),
    "xml_safe": (tx.xml_safe, "a\x01b", "ab"), "note_safe": (tx.note_safe, "a|b\nc", "a｜b／c"), "pasted": (tx.pasted, "a \r\nb", "a\nb"), "tsv_escape": (tx.tsv_escape, "a\tb\\", "a\\tb\\\\"), "tsv_unescape": (tx.tsv_unescape, "a\\tb\\\\", "a\tb\\"),
    "joined_wide": (ocr.joined_wide, "柚 木 a b", "柚木 a b"), "display_width": (lambda c: tx.display_width(c).cast("string"), "aあ", "1.5"), "column_number": (lambda c: tx.column_number(c).cast("string"), "AB", "28"),
}


@case("name got", [(name, want) for name, (_, _, want) in FUNCTIONS.items()])
def functions_of_texts(spark):
    rows = spark.createDataFrame([(1,)], "doc_id long").select("doc_id", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), f(F.lit(given)).alias("got")) for name, (f, given, _) in FUNCTIONS.items()])).alias("r"))
    return rows.select("doc_id", "r.*")


PREDICATES = {
    "is_han": ("柚木", "見ほん"), "is_kana": ("みホん", "見"), "same_digit_run": ("000-0000", "0000012"), "is_masked": ("〇●", "〇本"), "has_mask_and_han": ("柚〇", "〇〇"), "is_organisation": ("鈴音クリニック", "朔也"), "has_counter": ("3回", "回"),
    "is_kanji_number": ("三回", "三郎"), "escape_only": ("_x000D_", "a_x000D_"), "strong_room": ("101号", "101"), "room_number": ("A-101", "A-10100"), "safe_name": ("a.docx", "../a"), "safe_path": ("a/b.docx", "a/b/c"), "is_placeholder": (" なし ", "あり"), "is_checkbox": ("口", "目"),
}


@case("name yes no", [(name, True, False) for name in PREDICATES])
def predicates_of_texts(spark):
    tests = [F.struct(F.lit(n).alias("name"), getattr(predicates, n)(F.lit(yes)).alias("yes"), getattr(predicates, n)(F.lit(no)).alias("no")) for n, (yes, no) in PREDICATES.items()]
    return spark.createDataFrame([(1,)], "doc_id long").select("doc_id", F.explode(F.array(*tests)).alias("r")).select("doc_id", "r.*")

"""Registry, records, lineage, lookup, cells, sources and the stream on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from veilspark.functions import text as tx
from veilspark.operators import cells, codebook, lineage, lookup, records, registry
from veilspark.sources import files, ooxml, tables
from veilspark.streaming import masking

REGISTRY = "row_no int, kind string, name string, aliases array<string>, reading string"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, tx.addr_canon(lit("〒999－9999　朧月県瑠璃市鈴音町１ー２ー３"))) == "瑠璃市鈴音町1-2-3"
    assert one(spark, tx.hiragana(lit("ユズキ"))) == "ゆずき" and one(spark, tx.katakana(lit("ゆずき"))) == "ユズキ"
    assert one(spark, tx.clean_alias(lit(" a、b /a／ "))) == "a／b"
    assert [one(spark, tx.column_name(lit(n))) for n in (1, 26, 27, 702, 703, 16384)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert [one(spark, tx.column_number(lit(n))) for n in ("A", "Z", "AA", "ZZ", "AAA", "XFD")] == [1, 26, 27, 702, 703, 16384]
    assert one(spark, tx.flexible_date(lit("令和元年５月１日"))) == dt.date(2019, 5, 1) and one(spark, tx.flexible_date(lit("R6.2.30"))) is None
    assert one(spark, tx.era_long(lit("2019-05-01").cast("date"))) == "令和元年5月1日" and one(spark, tx.era_short(lit("2024-04-01").cast("date"))) == "R6.4.1"
    assert one(spark, tx.care_level(lit("要介護３"))) == 3 and one(spark, tx.care_reason(lit("要支援1"))) == "support level"
    assert one(spark, tx.kana_row(lit("ぱんだ"))) == "ハ" and one(spark, tx.display_width(lit("aあ\tｱ"))) == 4.0
    for text in ("a\tb\\n\nc\\", "\\t", "\\\\t\t"):
        assert one(spark, tx.tsv_unescape(tx.tsv_escape(lit(text)))) == text
    assert one(spark, tx.job_folder(lit("利用者001_計画書（R6.4）")))["month"] == "R6.4"


def test_registry_merges_and_owners(spark):
    reg = spark.createDataFrame([(1, "利用者", "柚木朔也", ["a"], ""), (2, "利用者", "柚木 朔也", ["b", "a"], "ゆずき"), (3, "家族", "柚木 莉央", [], "")], REGISTRY)
    rows = {r["name"]: r for r in registry.merged(reg).collect()}
    assert rows["柚木 朔也"]["aliases"] == ["a", "b"] and rows["柚木 朔也"]["n_rows"] == 2 and registry.duplicates(reg).count() == 1
    words = spark.createDataFrame([("柚木〇也",), ("●木莉央",), ("〇〇",), ("柚木次郎",)], "word string")
    assert {(r["word"], r["person"]) for r in registry.masked_owners(words, reg).collect()} == {("柚木〇也", "柚木朔也"), ("●木莉央", "柚木莉央")}


def test_inferred_years_walk_both_ways(spark):
    rows = [("b", 1, 2, None), ("b", 2, 12, None), ("b", 3, 11, 2023), ("b", 4, 12, None), ("b", 5, 1, None), ("c", 1, 9, None), ("c", 2, 10, None)]
    out = records.inferred_years(spark.createDataFrame(rows, "book string, row int, month int, marked_year int"), 2024, 8).orderBy("book", "row")
    assert [r["year"] for r in out.collect()] == [2024, 2023, 2023, 2022, 2022, 2023, 2022]


def test_ocr_rows_compare_with_the_first_line(spark):
    lines = ["#PAGE 1", "0\t50\t10\tB", "7\t0\t10\tA", "12\t0\t10\tC", "#PAGE 2", "5\t1\t10\tD"]
    text = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, n int, line string")
    out = records.ocr_rows(records.ocr_lines(text)).orderBy("page", "row")
    assert [(r["page"], r["text"]) for r in out.collect()] == [(1, "A　B"), (1, "C"), (2, "D")]


def test_chunks_lists_and_names(spark):
    recs = spark.createDataFrame([(1, ["あ" * 1300, "い"])], "record_id int, paras array<string>")
    out = records.chunked(recs).orderBy("chunk").collect()
    assert [r["lines"] for r in out] == [20, 20, 2] and "".join("".join(r["paras"]) for r in out) == "あ" * 1300 + "い"
    days = spark.createDataFrame([(dt.date(2024, 4, 1), 2, "訪問", ["x", "y"])], "day date, nth int, kind string, paras array<string>")
    assert [(r["date"], r["sort_key"], r["continuation"]) for r in records.list_rows(days).orderBy("pos").collect()] == [(dt.date(2024, 4, 1), "20240401-02", 0), (None, "20240401-02", 1)]
    want = spark.createDataFrame([("b", "4.1"), ("b", "4.2")], "book string, name string")
    used = spark.createDataFrame([("b", "4.1"), ("b", "4.1②")], "book string, name string")
    assert {r["name"]: r["free"] for r in records.free_names(want, used).collect()} == {"4.1": "4.1③", "4.2": "4.2"}


def test_lineage(spark):
    rows = [("M", "p1", "ok", "s1", "r1"), ("M", "p2", "ok", "s1", "r1"), ("M", "p2", "ok", "s2", "r2"), ("M", "p3", "held", "s3", "r3"), ("S", "s1", None, None, "j1"), ("S", "s2", None, None, "j2")]
    led = spark.createDataFrame([(k, None, *r) for k, *r in rows], "kind string, at timestamp, h1 string, status string, h2 string, ref string")
    assert [(r["source"], r["job"]) for r in lineage.owned_sources(led).collect()] == [("p1", "j1")]
    plan = {r["item"]: (r["include"], r["reason"]) for r in lineage.clean_plan(led, "j1").collect()}
    assert plan == {"p1": (True, None), "p2": (False, "shared source"), "s1": (True, None), "r1": (False, "shared report")}
    tree = spark.createDataFrame([("a", "x", 1, "h"), ("a", "y", 2, "i"), ("b", "y", 2, "i"), ("b", "x", 1, "h"), ("c", "x", 1, "i")], "root string, path string, size long, hash string")
    sig = {r["root"]: r["signature"] for r in lineage.tree_signature(tree).collect()}
    assert sig["a"] == sig["b"] != sig["c"]


def test_send_gate(spark):
    rows = [(1, 1, 0, ["u"], "u", 0, False), (2, 0, 1, ["u"], "u", 0, False), (3, 0, 0, [], "u", 0, False), (4, 0, 0, ["v"], "u", 0, False), (5, 0, 0, ["u", "v"], "u", 0, False), (6, 0, 0, ["u", "v"], "u", 0, True), (7, 0, 0, ["u"], "u", 1, False)]
    df = spark.createDataFrame(rows, "doc_id int, pending int, registered int, users array<string>, chosen string, suspects int, confirmed boolean")
    assert [r["reason"] for r in lineage.send_gate(df).orderBy("doc_id").collect()] == ["unprocessed sources", "registered word left", "no user found", "other user", "mixed users", None, "suspect in note"]


def test_lookup(spark):
    d = dt.date
    certs = spark.createDataFrame([("柚木 朔也", "要介護1", d(2020, 1, 1), d(2021, 1, 1)), ("柚木朔也", "要介護2", d(2024, 1, 1), d(2025, 1, 1)), ("柚木莉央", "要介護3", d(2030, 1, 1), d(2031, 1, 1))], "name string, level string, start date, end date")
    persons = spark.createDataFrame([("柚木　朔也", "ゆずきたろう", "1940-01-01", "x"), ("柚木莉央", "ア", "1", "x"), ("柚木莉央", "イ", "1", "x")], "name string, kana string, birth string, address string")
    out = {r["name"]: r for r in lookup.find(spark.createDataFrame([("柚木朔也",), ("柚木莉央",), ("無名",)], "name string"), persons, certs, F.lit("2025-01-01").cast("date")).collect()}
    assert out["柚木朔也"]["level"] == "要介護2" and out["柚木朔也"]["valid"] and out["柚木朔也"]["reason"] is None
    assert out["柚木莉央"]["reason"] == "ambiguous" and out["無名"]["reason"] == "not found"


def test_formula_closure_stops_after_six_rounds(spark):
    rows = [(1, "S", "A1", "n", "1", None)] + [(1, "S", f"A{i}", "n", "", f"=$A${i - 1}+'T x'!B2") for i in range(2, 11)] + [(1, "T x", "B2", "s", "秘密", None)]
    cs = spark.createDataFrame(rows, "doc_id long, sheet string, ref string, type string, text string, formula string")
    t = spark.createDataFrame([("S", "A1", "氏名")], "sheet string, ref string, label string")
    assert sorted(int(r["ref"][1:]) for r in cells.registered(cs, t).collect()) == list(range(1, 8))
    both = spark.createDataFrame([("T x", "B2", "氏名")], "sheet string, ref string, label string")
    assert cells.registered(cs, both).count() == 10
    assert [(r["ref"], r["space"]) for r in cells.masked(cs, cells.registered(cs, t)).filter("orig <> ''").collect()] == [("A1", "数")]


def test_cells_beside_a_label(spark):
    cs = cells.addressed(spark.createDataFrame([(1, "S", r, t) for r, t in (("B2", "生年月日："), ("D2", "右"), ("B4", "下"), ("A1", "外"), ("C3", "斜"))], "doc_id long, sheet string, ref string, text string"))
    assert {(r["text"], r["distance"]) for r in cells.beside_label(cs).collect()} == {("右", 2), ("下", 2)}


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("氏名;生年月日\n柚木 朔也;昭和15年3月2日;余り\n\n;\n".encode("cp932"))
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbf" + "氏名\t要介護度\t開始日\nx\t1\t2\n".encode())
    found = files.listing(spark, f"file://{tmp_path}")
    rows = tables.delimited(found)
    got = {(r["path"][-5:], r["n"]): (r["encoding"], r["cells"]) for r in rows.collect()}
    assert got[("a.csv", 1)] == ("cp932", ["柚木 朔也", "昭和15年3月2日", "余り"]) and got[("b.csv", 0)][0] == "utf-8-sig" and len(got) == 4
    kinds = tables.newest_of_kind(rows, found, {"person": tables.PERSON, "certificate": tables.CERTIFICATE})
    assert {(r["kind"], r["cells"][0]) for r in kinds.collect()} == {("person", "柚木 朔也"), ("certificate", "x")}


def test_codebook_file_round_trip(spark, tmp_path):
    rows = [("型|番号|1\t2", "番号", 1, "【番号001】", "1\t2\\n", "1\t2\\n", False, False), ("名|利用者|柚木朔也", "利用者", 12, "【利用者012】", "柚木 朔也", "柚木朔也", True, False)]
    book = spark.createDataFrame(rows, codebook.SCHEMA)
    tables.write_codebook(book, f"file://{tmp_path}/book")
    back = tables.read_codebook(spark, f"file://{tmp_path}/book")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, book.collect()))


def test_small_tables(spark, tmp_path):
    (tmp_path / "ledger.tsv").write_text("M\t2024-01-01 00:00:00\th1\tok\th2\tr\nS\t2024-01-01 00:00:00\th2\tj\nx\n", "utf-8")
    assert [(r["kind"], r["h2"], r["ref"]) for r in tables.read_ledger(spark, f"file://{tmp_path}/ledger.tsv").collect()] == [("M", "h2", "r"), ("S", None, "j")]
    (tmp_path / "state.json").write_text('{"src": {"a": {"at": "t", "how": "x", "tries": 2}}, "stage": {}}', "utf-8")
    assert [tuple(r) for r in tables.read_intake(spark, f"file://{tmp_path}/state.json").collect()] == [("src", "a", "t", "x", 2)]
    (tmp_path / "r.md").write_text("# 依頼\n- 状態: 未\n- 場所：A\n- 状態: 済\n", "utf-8")
    assert {(r["field"], r["value"]) for r in tables.requests(spark, f"file://{tmp_path}/r.md").collect()} == {("状態", "済"), ("場所", "A")}
    rows = spark.createDataFrame([("p", 0, "utf-8", ["区分", "氏名", "呼び名", "フリガナ"]), ("p", 1, "utf-8", ["", "柚木 朔也", "a/b", "ゆずき"]), ("p", 2, "utf-8", ["家族", ""])], tables.ROWS.removesuffix(", reason string"))
    assert [tuple(r) for r in tables.registry_of(rows).collect()] == [(1, "人物", "柚木 朔也", ["a", "b"], "ゆずき")]
    config = spark.createDataFrame([("S", "氏名", "$A$1、B2 C3")], "sheet string, label string, cells string")
    assert [r["ref"] for r in cells.target_list(config).collect()] == ["A1", "B2", "C3"]


def test_documents_are_read_and_rewritten(spark):
    content = ooxml.simple_document("題", ["柚木 朔也 & 莉央", "次"])
    df = spark.createDataFrame([(7, bytearray(content))], "doc_id long, content binary")
    assert [r["text"] for r in ooxml.document_units(df).orderBy("seq").collect()] == ["題", "柚木 朔也 & 莉央", "次"]
    new = ooxml.rewritten_documents(df, spark.createDataFrame([(7, 1, "【利用者001】 <x>")], "doc_id long, seq int, text string"))
    assert [r["text"] for r in ooxml.document_units(new).orderBy("seq").collect()] == ["題", "【利用者001】 <x>", "次"]


def test_stream_keeps_codes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    args = [f"file://{tmp_path}/{x}" for x in ("book", "out", "state")]

    def run():
        masking.mask_stream(masking.units_stream(spark, f"file://{src}"), *args).awaitTermination(120)

    (src / "1.json").write_text('{"doc_id": 1, "part_no": 0, "seq": 0, "text": "a@b.example"}\n')
    run()
    (src / "2.json").write_text('{"doc_id": 2, "part_no": 0, "seq": 0, "text": "c@d.example a@b.example"}\n')
    run()
    out = spark.read.parquet(args[1]).orderBy("doc_id").collect()
    assert [r["masked"] for r in out] == ["【メール001】", "【メール002】 【メール001】"]


def test_nearest_person_prefers_the_next_unit(spark):
    units = spark.createDataFrame([(1, i) for i in range(8)], "doc_id int, seq int")
    said = spark.createDataFrame([(1, 2, "a"), (1, 4, "b")], "doc_id int, seq int, person string")
    assert {r["seq"]: r["person"] for r in registry.nearest_person(units, said).collect()} == {0: "a", 1: "a", 2: "a", 3: "b", 4: "b", 5: "b", 6: "b", 7: "b"}

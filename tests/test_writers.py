"""Sinks."""

from pyspark.sql import functions as F

from veilspark.sources import tables, writers


def test_ledger_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("M", "2024-01-01 00:00:00", "h1", "ok", "h2", "r"), ("S", "2024-01-02 00:00:00", "h2", None, None, "j")], "kind string, at string, h1 string, status string, h2 string, ref string")
    writers.append_ledger(rows, f"file://{tmp_path}/l")
    writers.append_ledger(rows.limit(1), f"file://{tmp_path}/l")
    back = tables.read_ledger(spark, f"file://{tmp_path}/l")
    assert sorted((r["kind"], r["h2"], r["ref"]) for r in back.collect()) == [("M", "h2", "r"), ("M", "h2", "r"), ("S", None, "j")]


def test_log_shows_shapes_only(spark, tmp_path):
    writers.append_log(spark.createDataFrame([("t", "mask", "「柚木 朔也」 03-1234 【利用者001】")], "at string, screen string, message string"), f"file://{tmp_path}/log")
    assert spark.read.text(f"file://{tmp_path}/log").first()[0] == "t\tmask\t「…」 99-9999 「…」"


def test_report(spark):
    status = spark.createDataFrame([(1, "ok", 3, 0, 0), (2, "held", 0, 1, 0)], "doc_id int, status string, n_repl int, n_sus int, n_left int")
    counts = spark.createDataFrame([(1, "電話", "x", "【電話001】", 1), (1, "番号", "y", "【番号001】", 2)], "doc_id int, kind string, orig string, code string, n int")
    assert [r["lines"] for r in writers.mask_report(status, counts, 1).orderBy("doc_id").collect()] == [["番号 【番号001】 ×2"], []]


def test_files_never_replace(spark):
    new = spark.createDataFrame([("d", "a.docx", "h1"), ("d", "a.docx", "h2"), ("d", "b", "h3"), ("d", "c.x", "old")], "folder string, name string, hash string")
    there = spark.createDataFrame([("d", "a.docx", "h0"), ("d", "a(4).docx", "h9"), ("d", "z", "old")], "folder string, name string, hash string")
    got = writers.named_freely(new, there).orderBy("hash").select(F.col("free")).collect()
    assert [r[0] for r in got] == ["a(5).docx", "a(6).docx", "b"]

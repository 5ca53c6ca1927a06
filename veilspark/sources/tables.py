"""Delimited files of unknown encoding, and the small tables that a run keeps: codebook, registry,
ledger, cell configuration, intake state, requests."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import alias_list, tsv_escape, tsv_unescape
from .batches import pairs, together

ROWS = "path string, n int, encoding string, cells array<string>, reason string"
SCHEMA = pa.schema([("path", pa.string()), ("n", pa.int32()), ("encoding", pa.string()), ("cells", pa.list_(pa.string())), ("reason", pa.string())])
#: Bytes above which a delimited file isn't read; its row says so.
MOST_BYTES = 64 << 20
TOO_LARGE, DAMAGED = "too large", "damaged"
PERSON, CERTIFICATE = ("氏名", "生年月日"), ("氏名", "要介護", "開始")


def decoded(data: bytes) -> tuple[str, str]:
    """Text and its encoding: UTF-8 with or without a mark, else CP932 with holes replaced."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace"), "utf-8-sig"
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return data.decode("cp932", "replace"), "cp932"


def delimiter(line: str) -> str:
    """The most frequent of comma, tab and semicolon in the first line."""
    return max(",\t;", key=line.count)


def delimited(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of the delimited files in `files` (path, bytes, content), ragged as they are; blank rows go. A
    file that is too large or can't be parsed is one row without cells, with the reason."""

    def rows_of(path: str, content: bytes | None) -> list[tuple]:
        if content is None:
            return [(path, 0, None, None, TOO_LARGE)]
        text, encoding = decoded(content)
        try:
            reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter(text.partition("\n")[0]))
            return [(path, n, encoding, row, None) for n, row in enumerate(reader) if any(c.strip() for c in row)]
        except csv.Error as e:
            return [(path, 0, encoding, None, f"{DAMAGED}: {e}")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(most_bytes)
        yield from together((row for path, content in pairs(batches, "path", "content") for row in rows_of(path, content)), SCHEMA)

    return files.select("path", F.when(F.col("bytes") <= most_bytes, F.col("content")).alias("content")).mapInArrow(parse, ROWS)


def column_of(header: Column, token: str) -> Column:
    """Index of the header cell for token: the only one that contains it, else the only one that starts
    with it, else the only one that equals it; null if that is ambiguous."""
    at = F.transform(header, lambda h, i: F.struct(F.regexp_replace(h, r"[\s　]", "").alias("h"), i.alias("i")))

    def only(test) -> Column:
        hits = F.filter(at, lambda x: test(x["h"]))
        return F.when(F.size(hits) == 1, F.element_at(hits, 1)["i"])

    return F.coalesce(only(lambda h: h.contains(token)), only(lambda h: h.startswith(token)), only(lambda h: h == token))


def newest_of_kind(rows: DataFrame, files: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows of the newest file of each kind, a kind being the headers that its first row must have."""
    header = rows.groupBy("path").agg(F.min_by("cells", "n").alias("header"), F.min("n").alias("first"))
    kind = F.lit(None).cast("string")
    for name, tokens in kinds.items():
        has = F.lit(True)
        for t in tokens:
            has = has & column_of(F.col("header"), t).isNotNull()
        kind = F.when(has, name).otherwise(kind)
    classed = header.withColumn("kind", kind).filter("kind is not null").join(files.select("path", "modified"), "path")
    newest = classed.withColumn("_n", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("modified"), "path"))).filter("_n = 1")
    return rows.join(newest.select("path", "kind", "header", "first"), "path").filter(F.col("n") > F.col("first"))


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """A codebook file: key, orig, code, tab-separated with a header and escapes."""
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "^﻿", ""))
    part = F.split("value", "\t")
    rows = lines.filter(F.size(part) >= 3).select(*[tsv_unescape(part[i]).alias(c) for i, c in enumerate(("key", "orig", "code"))]).filter("code like '【%'")
    space = F.split("key", r"\|")[0]
    prefix, n = F.regexp_extract("code", "^【([^0-9０-９【】]+)", 1), F.regexp_extract("code", "^【[^0-9０-９【】]+([0-9]+)", 1).try_cast("long")
    spaceless = F.regexp_replace("orig", "[ 　]", "")
    return rows.select("key", prefix.alias("prefix"), n.alias("n"), "code", "orig", F.when(space == "名", spaceless).otherwise(F.col("orig")).alias("restore"), space.isin("名", "姓", "下", "別", "読").alias("is_name"), (space == "数").alias("is_numeric"))


def write_codebook(book: DataFrame, path: str) -> None:
    """Write key, orig, code as tab-separated text parts, appending."""
    line = F.concat_ws("\t", *[tsv_escape(F.col(c)) for c in ("key", "orig", "code")])
    book.select(line.alias("value")).write.mode("append").text(path)


def registry_of(rows: DataFrame) -> DataFrame:
    """Registry from delimited rows (n, cells) whose first row is the header: kind, name, aliases and, if
    the fourth header says so, reading."""
    head = rows.filter("n = 0").select("path", F.coalesce(F.try_element_at("cells", F.lit(4)).rlike("読|フリガナ|ふりがな|カナ"), F.lit(False)).alias("has"))
    cell = lambda i: F.trim(F.coalesce(F.try_element_at("cells", F.lit(i)), F.lit("")))
    body = rows.filter("n > 0").join(head, "path")
    return body.filter(cell(2) != "").select(F.col("n").alias("row_no"), F.when(cell(1) == "", "人物").otherwise(cell(1)).alias("kind"), cell(2).alias("name"), alias_list(cell(3)).alias("aliases"), F.when(F.col("has"), cell(4)).otherwise("").alias("reading"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("value", "\t")
    at = [F.try_element_at(part, F.lit(i)) for i in range(1, 7)]
    rows = spark.read.text(path).filter(F.col("value").rlike("^[MSR]\t"))
    return rows.select(at[0].alias("kind"), at[1].try_cast("timestamp").alias("at"), at[2].alias("h1"), F.when(at[0] == "M", at[3]).alias("status"), F.when(at[0] == "M", at[4]).alias("h2"), F.when(at[0] == "M", at[5]).otherwise(at[3]).alias("ref"))


def read_cell_config(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(part) >= 3))
    return rows.select(part[0].alias("sheet"), part[1].alias("label"), part[2].alias("cells")).filter("sheet <> 'sheet'")


def read_intake(spark: SparkSession, path: str) -> DataFrame:
    """Intake state (JSON with the maps src and stage) as where, file, at, how, tries."""
    entry = "map<string,struct<at:string,how:string,tries:int>>"
    state = spark.read.schema(f"src {entry}, stage {entry}").option("multiLine", "true").json(path)
    both = [state.select(F.lit(w).alias("where"), F.explode(w).alias("file", "e")).select("where", "file", "e.*") for w in ("src", "stage")]
    return both[0].unionByName(both[1])


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Fields of request notes in markdown (`- 項目: 値` lines); a field's last value counts."""
    notes = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("note"))
    pairs = notes.select("path", F.posexplode(F.regexp_extract_all("note", F.lit(r"(?m)^[-*]\s*[^:：\n]+[:：].*$"), F.lit(0))).alias("pos", "line"))
    field, value = F.trim(F.regexp_extract("line", r"^[-*]\s*([^:：]+)", 1)), F.trim(F.regexp_extract("line", r"^[-*]\s*[^:：]+[:：](.*)$", 1))
    return pairs.select("path", field.alias("field"), value.alias("value"), "pos").groupBy("path", "field").agg(F.max_by("value", "pos").alias("value"))

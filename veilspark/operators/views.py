"""Views: texts without what disturbs matching, with a map back to the source.

A view leaves out what a pattern names and keeps a table of segments: where a kept stretch begins in the
view and in the source. Whatever is found in the view is mapped back by looking up the segments of its
first and last character; the span in the source then holds what was left out inside it. Some seams are
walls: nothing that crosses one is a finding, so it is refused.

The table of segments is made in Arrow batches, one pass over the text; finding and mapping are column
functions. A text without seams has one segment.

Defined cases: a null text has a null view; an empty one, or one that is left out whole, an empty view with no
segments. Empty matches in the view are no findings. Very long texts cost their length and, for each finding, a
search of their segments.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import matches

VIEW = "struct<text:string,segments:array<struct<at:int,src:int,n:int,wall:boolean>>>"
ARROW = pa.struct([("text", pa.string()), ("segments", pa.list_(pa.struct([("at", pa.int32()), ("src", pa.int32()), ("n", pa.int32()), ("wall", pa.bool_())])))])
#: Characters between digits of one number; a line break there is a wall.
GROUPED = r"(?<=[0-9])(?P<cut>[ -]+)(?=[0-9])|(?<=[0-9])(?P<wall>[ -]*(?:\n[ -]*)+)(?=[0-9])"
#: Codes of a sheet's header or footer: its three sections are walls, && stands for one.
HEADER = r'(?P<wall>&[LCR])|(?P<first>&&)|(?P<cut>&"[^"]*"|&K[0-9A-Fa-f]{6}|&[0-9]+|&[A-Za-z])'
#: Character references that stand for a character of one's own.
REFERENCES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
REFERENCE = r"(?P<ref>&(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});)"
#: The same where only references are characters: an ampersand that begins none, as one broken off, is in no finding.
STRICT = REFERENCE + "|(?P<bare>&)"


def referred(reference: str) -> str:
    """The character of a reference; itself if there is none."""
    name = reference[1:-1]
    if name[0] != "#":
        return REFERENCES[name]
    code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else reference


def segmented(text: str, pattern: re.Pattern) -> dict:
    """The view of a text. Groups of the pattern: cut and wall are left out, of first the first character
    stays, ref becomes its character, bare a NUL, which no pattern finds."""
    pieces, segments, at, last, wall = [], [], 0, 0, False

    def keep(piece: str, src: int, n: int) -> None:
        nonlocal at, wall
        if piece:
            pieces.append(piece)
            segments.append({"at": at, "src": src, "n": n, "wall": wall})
            at, wall = at + len(piece), False

    for m in pattern.finditer(text):
        if m.end() == m.start():
            continue
        keep(text[last : m.start()], last, m.start() - last)
        kind, last = m.lastgroup, m.end()
        if kind == "first":
            keep(m[0][0], m.start(), len(m[0]))
        elif kind == "ref":
            character = referred(m[0])
            keep(character, m.start(), len(m[0]))
        elif kind == "bare":
            keep("\x00", m.start(), len(m[0]))
        elif kind == "wall":
            wall = True
    keep(text[last:], last, len(text) - last)
    return {"text": "".join(pieces), "segments": segments}


def with_view(df: DataFrame, pattern: str, text: str = "text", name: str = "view") -> DataFrame:
    """df with the view of a text column."""
    compiled, schema = re.compile(pattern), df.drop(name).withColumn(name, F.lit(None).cast(VIEW)).schema

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = pa.array([None if t is None else segmented(t, compiled) for t in batch.column(text).to_pylist()], ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, views], names=[*batch.schema.names, name])

    return df.drop(name).mapInArrow(batches_of, schema)


def matched(view: Column, pattern: str) -> Column:
    """array<struct<st, en>> of the pattern's matches in the view."""
    return F.transform(matches(view["text"], pattern), lambda m: F.struct(m["st"].cast("int").alias("st"), (m["st"] + F.length(m["orig"])).cast("int").alias("en")))


def mapped(view: Column, spans: Column) -> Column:
    """array<struct<st, en>> in the source of the spans in the view, without those that cross a wall."""
    segments = view["segments"]

    def of(place: Column) -> Column:
        return F.try_element_at(F.filter(segments, lambda s: s["at"] <= place), F.lit(-1))

    def crosses(span: Column) -> Column:
        return F.exists(segments, lambda s: s["wall"] & (s["at"] > span["st"]) & (s["at"] < span["en"]))

    def back(span: Column) -> Column:
        # What stands for one character is taken whole: its segment has another length in the source.
        first, last = of(span["st"]), of(span["en"] - 1)
        end = last["src"] + F.least(last["n"], span["en"] - last["at"])
        after = F.try_element_at(F.filter(segments, lambda s: s["at"] >= span["en"]), F.lit(1))
        whole = F.when(after["at"] == last["at"] + 1, last["src"] + last["n"]).when(after.isNull() & (F.length(view["text"]) == last["at"] + 1), last["src"] + last["n"])
        return F.struct((first["src"] + span["st"] - first["at"]).alias("st"), F.coalesce(whole, end).alias("en"))

    return F.transform(F.filter(spans, lambda s: (s["en"] > s["st"]) & ~crosses(s)), back)


def replaced(text: Column, spans: Column, code: Callable[[Column], Column]) -> Column:
    """The text with its spans (in order, apart) replaced by code(source of the span), and all else as it was."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(a: Column, s: Column) -> Column:
        new = code(F.substring(text, s["st"] + 1, s["en"] - s["st"]))
        return F.struct(s["en"].cast("int").alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["st"] - a["at"]), new).alias("out"))

    done = F.aggregate(spans, start, put)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def header_masked(headers: DataFrame, pattern: str, code: str, text: str = "text") -> DataFrame:
    """headers with `masked`: findings in the view without format codes are replaced; codes that stood
    inside one follow it, so that what comes after keeps its looks."""
    inner = F.lit(r'&"[^"]*"|&K[0-9A-Fa-f]{6}|&[0-9]+|&[A-Za-z]')
    viewed = with_view(headers, HEADER, text)
    spans = mapped(F.col("view"), matched(F.col("view"), pattern))
    return viewed.withColumn("masked", replaced(F.col(text), spans, lambda source: F.concat(F.lit(code), F.array_join(F.regexp_extract_all(source, inner, F.lit(0)), "")))).drop("view")

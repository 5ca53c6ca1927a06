"""Spans in a text: greedy choice among overlaps, replacement, segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import SPAN, TOKEN, located


def fold(candidates: Column, text: Column) -> Column:
    """Accept spans left to right: earlier start first, longer before shorter, then by priority. A span
    that overlaps an accepted one or a code already in the text is skipped, and skipping leaves the
    place where the next may start unchanged."""
    tokens = F.when(text.contains("【"), located(text, TOKEN)).otherwise(F.array().cast("array<struct<st:int,orig:string>>"))
    free = F.filter(candidates, lambda s: ~F.exists(tokens, lambda t: (s["st"] < t["st"] + F.length(t["orig"])) & (s["st"] + s["len"] > t["st"])))
    keyed = F.array_sort(F.transform(free, lambda s: F.struct(s["st"].alias("st"), (-s["len"]).alias("neg"), s["prio"].alias("prio"), s["kind"].alias("kind"), s["orig"].alias("orig"))))

    def step(acc: Column, s: Column) -> Column:
        one = F.struct(s["st"].alias("st"), (-s["neg"]).alias("len"), s["prio"].alias("prio"), s["kind"].alias("kind"), s["orig"].alias("orig"))
        taken = F.struct((s["st"] - s["neg"]).alias("upto"), F.concat(acc["out"], F.array(one)).alias("out"))
        return F.when((s["st"] >= acc["upto"]) & (s["neg"] < 0), taken).otherwise(acc)

    return F.aggregate(keyed, F.struct(F.lit(0).alias("upto"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])


def replaced(text: Column, spans: Column) -> Column:
    """text with each span (array<struct<st, len, code>>, ordered, apart) replaced by its code."""
    end = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, s: F.struct((s["st"] + s["len"]).alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["st"] - acc["at"]), s["code"]).alias("out")), lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, end).otherwise(text)


def context(text: Column, st: Column, length: Column, around: int = 15) -> Column:
    """A span with up to `around` characters on either side."""
    first = F.greatest(st - around, F.lit(0))
    return F.substring(text, first + 1, st - first + length + around)


def segments(text: Column, spans: Column) -> Column:
    """The text as array<struct<kind, text>>: `plain` between spans, and each span with its kind."""
    seg = "array<struct<kind:string,text:string>>"

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["st"] - acc["at"])
        parts = F.array(F.struct(F.lit("plain").alias("kind"), gap.alias("text")), F.struct(s["kind"].alias("kind"), F.substring(text, s["st"] + 1, s["len"]).alias("text")))
        return F.struct((s["st"] + s["len"]).alias("at"), F.concat(acc["out"], parts).alias("out"))

    all_ = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast(seg).alias("out")), step, lambda acc: F.concat(acc["out"], F.array(F.struct(F.lit("plain").alias("kind"), F.substring(text, acc["at"] + 1, F.length(text)).alias("text")))))
    return F.filter(all_, lambda p: p["text"] != "")

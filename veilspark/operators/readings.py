"""Readings of written names: the pairs that workbooks keep, and which part of a reading belongs to which character.

Base text and reading are aligned from left to right by dynamic programming: kana must meet the same sound, and each
other character takes one to `most` sounds, as evenly as the whole allows. Whether there is a way at all is found first,
with a bit for each place; then the table of costs is kept in a band around an even pace, which is
doubled until it holds a way. So a pair that goes on evenly takes memory in proportion to its length, and the most even
way is that of its band.

Defined cases: kana of either script are equal; a text that is null gives null, and so does a pair that can't be
aligned, as one with too few or too many sounds. Two empty texts are aligned with no parts. Blanks in either are left
out. Of equally even ways the one whose first characters take fewer sounds is taken. Repeated rows are aligned each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import hiragana

#: Sounds that one character has at most, and sounds by which a reading may lie off its even pace.
MOST, BAND = 6, 64
PARTS = "array<struct<base:string,reading:string>>"
#: The references of XML by name; the one that begins others comes last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
_NONE = np.int64(1) << 40


def ruby_pairs(xml: Column) -> Column:
    """Base text and reading of strings of a workbook's XML that have one: array<struct<base, reading>>."""
    def texts(x: Column) -> Column:
        text = F.array_join(F.regexp_extract_all(x, F.lit(r"<t(?:\s[^>]*)?>([^<]*)</t>"), F.lit(1)), "")
        for name, char in REFERENCES:
            text = F.replace(text, F.lit(name), F.lit(char))
        return text

    def pair(item: Column) -> Column:
        ruby = r"(?s)<rPh\b[^>]*>.*?</rPh>"
        return F.struct(texts(F.regexp_replace(item, ruby, "")).alias("base"), texts(F.array_join(F.regexp_extract_all(item, F.lit(ruby), F.lit(0)), "")).alias("reading"))

    items = F.filter(F.regexp_extract_all(xml, F.lit(r"(?s)<(?:si|is)>.*?</(?:si|is)>"), F.lit(0)), lambda x: x.contains("<rPh"))
    return F.filter(F.transform(items, pair), lambda p: (p["base"] != "") & (p["reading"] != ""))


def _kana(c: str) -> bool:
    return "ぁ" <= c <= "ゖ" or c == "ー"


def aligned_pair(base: str, reading: str, most: int = MOST, band: int = BAND) -> list[int] | None:
    """How many sounds each character of base takes, None if there is no way. Texts are in hiragana.

    A character that takes n sounds costs n * n, so that even ways cost least."""
    n, m = len(base), len(reading)
    if n == 0:
        return [] if m == 0 else None
    # Kana of the base set the pace: between them the other characters share what is left.
    solid = np.fromiter((not _kana(c) for c in base), bool, n)
    pace = (m - (~solid).sum()) / max(1, solid.sum())
    if m < n:
        return None
    centre = np.rint(np.concatenate(([0], np.cumsum(np.where(solid, pace, 1))))).astype(np.int64)
    low = np.clip(centre - band, 0, m)
    width = 2 * band + 1
    sound = np.frombuffer(reading.encode("utf-32-le"), np.uint32)
    cost = np.full(width, _NONE)
    # From the end, so that following the choices from the start takes the fewest sounds first.
    cost[m - low[n]] = 0
    taken = np.zeros((n, width), np.uint8)
    for i in range(n - 1, -1, -1):
        best = np.full(width, _NONE)
        at = low[i] + np.arange(width)
        for k in range(1, most + 1) if solid[i] else (1,):
            goal = at + k - low[i + 1]
            ok = (goal >= 0) & (goal < width) & (at + k <= m)
            if not solid[i]:
                ok &= sound[np.minimum(at, m - 1)] == ord(base[i])
            new = np.where(ok, cost[np.clip(goal, 0, width - 1)] + (k * k if solid[i] else 0), _NONE)
            better = new < best
            best[better], taken[i, better] = new[better], k
        cost = best
    if cost[0 - low[0]] >= _NONE:
        return None
    out, at = [], 0
    for i in range(n):
        k = int(taken[i, at - low[i]])
        out.append(k)
        at += k
    return out


def possible(base: str, reading: str, most: int = MOST) -> bool:
    """Whether there is a way: bit j is set if the characters so far can take the first j sounds."""
    sounds: dict[str, int] = {}
    for j, c in enumerate(reading):
        sounds[c] = sounds.get(c, 0) | 1 << j
    reached, all_ = 1, (1 << len(reading) + 1) - 1
    for c in base:
        if _kana(c):
            reached = (reached & sounds.get(c, 0)) << 1
        else:
            once, reached = reached, 0
            for k in range(1, most + 1):
                reached |= once << k
        reached &= all_
        if not reached:
            return False
    return bool(reached >> len(reading) & 1)


def in_a_band(base: str, reading: str) -> list[int] | None:
    """The way in the first band that holds one."""
    if not possible(base, reading):
        return None
    band = BAND
    while (found := aligned_pair(base, reading, band=band)) is None:
        band *= 2
    return found


def _sounds(base: Column, reading: Column) -> Column:
    @F.pandas_udf("array<int>")
    def sounds(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bases, readings in parts:
            yield pd.Series([None if b is None or r is None else in_a_band(b, r) for b, r in zip(bases, readings, strict=True)], dtype=object)

    return sounds(base, reading)


def aligned(base: Column, reading: Column) -> Column:
    """The characters of base with their parts of the reading: array<struct<base, reading>>; null where
    they don't fit."""
    base, reading = F.regexp_replace(base, r"[\s　]", ""), F.regexp_replace(reading, r"[\s　]", "")
    sounds = _sounds(hiragana(base), hiragana(reading))

    def step(acc: Column, k: Column) -> Column:
        char = F.substring(base, acc["i"] + 1, F.lit(1))
        one = F.struct(char.alias("base"), F.substring(reading, acc["at"] + 1, k).alias("reading"))
        return F.struct((acc["i"] + 1).alias("i"), (acc["at"] + k).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(sounds, F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast(PARTS).alias("out")), step, lambda acc: acc["out"])

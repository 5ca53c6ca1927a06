"""Entities broken over units: a plain version over all units put together, addresses with their codes, odd rows."""

import random
import re

from pyspark.sql import functions as F

from veilspark.functions.patterns import SPAN, located
from veilspark.operators import codebook, fragments

UNITS = "doc_id long, part_no int, seq int, text string, extra string"
#: Entities are capital letters in a row; a unit goes on if letters stand on both sides of the border.
LETTERS = fragments.Joint("[A-Z]$", "^[A-Z]")


def letters(text):
    return F.transform(located(text, "[A-Z,]*[A-Z]{3,}[A-Z,]*"), lambda m: F.struct(m["st"].alias("st"), F.length(m["orig"]).alias("len"), F.lit(0).alias("prio"), F.lit("x").alias("kind"), m["orig"].alias("orig"))).cast(SPAN)


def plain(rows):
    """Units one after the other; the pieces of what is found in a run of units that go on."""
    out, runs = [], []
    for d, p, s, t, _ in sorted((r for r in rows), key=lambda r: r[:3]):
        last = runs[-1][-1] if runs else None
        if last and last[:3] == (d, p, s - 1) and last[3] and t and re.search("[A-Z]$", last[3]) and re.match("[A-Z]", t):
            runs[-1].append((d, p, s, t))
        else:
            runs.append([(d, p, s, t)])
    for run in (r for r in runs if len(r) > 1):
        where = [(u, i) for u in run for i in range(len(u[3]))]
        whole = "".join(u[3] for u in run)
        for m in re.finditer("[A-Z,]*[A-Z]{3,}[A-Z,]*", whole):
            found, last = [], None
            for i in range(*m.span()):
                if whole[i] == ",":
                    last = None
                    continue
                unit, at = where[i]
                if last != unit:
                    found.append([*unit[:3], at, ""])
                    last = unit
                found[-1][4] += whole[i]
            out += [(*f, n) for n, f in enumerate(found)]
    return sorted(out)


def test_equals_a_plain_version(spark):
    rng = random.Random(8)
    rows = []
    for doc in range(60):
        for seq in range(14):
            if rng.random() > 0.1:
                rows.append((doc, doc % 2, seq, rng.choice((None, "", "AB", "ABC,D", "A", "abc", "xAB", "ABx", "xABCy,AB", ",AB", "AB,", "A" * 3000)), "e"))
    got = fragments.pieces(spark.createDataFrame(rows, UNITS), LETTERS, letters)
    assert sorted(tuple(r) for r in got.select("doc_id", "part_no", "seq", "st", "orig", "piece").collect()) == plain(rows)
    assert len(plain(rows)) > 100
    assert fragments.pieces(spark.createDataFrame([], UNITS), LETTERS, letters).collect() == []


def test_codes_of_broken_addresses(spark):
    """The same address broken elsewhere has the same base; each spelling restores as it was written."""
    rows = [
        (1, 0, 0, "現住所：汀野県藍浜市", ""), (1, 0, 1, "帆影町3丁目", ""), (1, 0, 2, "12-4　凪ハイツ101号室", ""),
        (2, 0, 5, "汀野県藍浜市帆影町", ""), (2, 0, 6, "3丁目12-4　凪ハイツ101号室", ""),
        (3, 0, 0, "汀野県藍浜市", ""), (3, 0, 2, "帆影町3丁目12-4", ""), (4, 0, 0, "汀野県藍浜市帆影町9丁目1-2", ""), (5, 0, 0, None, ""), (5, 0, 1, "", ""),
    ]
    units = spark.createDataFrame(rows, UNITS)
    found, more = fragments.coded(fragments.address_pieces(units), codebook.empty(spark))
    got = {(r.doc_id, r.seq): (r.st, r.orig, r.code) for r in found.collect()}
    assert got == {
        (1, 0): (4, "汀野県藍浜市", "【住所001】"), (1, 1): (0, "帆影町3丁目", "【住所001の続き1】"), (1, 2): (0, "12-4　凪ハイツ101号室", "【住所001の続き2】"),
        (2, 5): (0, "汀野県藍浜市帆影町", "【住所001の続き3】"), (2, 6): (0, "3丁目12-4　凪ハイツ101号室", "【住所001の続き4】"),
    }
    masked = spark.createDataFrame([(d, 0, s, code, "") for (d, s), (_, _, code) in got.items()], UNITS)
    restored = {(r.doc_id, r.seq): r.restored for r in codebook.restore(masked, more).collect()}
    assert restored == {k: orig for k, (_, orig, _) in got.items()}
    # With the book of before nothing new is needed.
    again, none = fragments.coded(fragments.address_pieces(units), more)
    assert none.count() == 0 and {(r.doc_id, r.seq): r.code for r in again.collect()} == {k: v[2] for k, v in got.items()}

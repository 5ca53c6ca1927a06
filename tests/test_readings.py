"""Alignment of readings against all ways, and the pairs of a workbook's strings."""

import itertools
import random

from pyspark.sql import functions as F

from veilspark.operators import readings


def brute(base, reading, most):
    """The first of the most even ways, in order of the sounds taken."""
    ways = []
    for ks in itertools.product(*[(1,) if readings._kana(c) else range(1, most + 1) for c in base]):
        if sum(ks) == len(reading):
            at = list(itertools.accumulate(ks, initial=0))
            if all(not readings._kana(c) or reading[a] == c for c, a in zip(base, at, strict=False)):
                ways.append((sum(k * k for k, c in zip(ks, base, strict=True) if not readings._kana(c)), ks))
    return list(min(ways)[1]) if ways else None


def test_equals_all_ways():
    rng, some = random.Random(3), 0
    for _ in range(900):
        base = "".join(rng.choice("山川のと") for _ in range(rng.randrange(6)))
        reading = "".join(rng.choice("のとあ") for _ in range(rng.randrange(12)))
        want = brute(base, reading, 4)
        got = readings.aligned_pair(base, reading, 4)
        assert got == want and readings.possible(base, reading, 4) == (want is not None)
        some += bool(want)
    assert some > 100


def test_long_texts():
    base, reading = "柚木の" * 4000, "ゆずきの" * 4000
    ks = readings.in_a_band(base, reading)
    assert sum(ks) == len(reading) and ks[2::3] == [1] * 4000 and all(a + b == 3 for a, b in zip(ks[::3], ks[1::3], strict=True))
    # The pace is uneven by far more than the first band.
    base, reading = "山" * 300 + "の" + "川" * 300, "や" * 300 + "の" + "かわ" * 300
    assert readings.in_a_band(base, reading) == [1] * 301 + [2] * 300
    assert readings.in_a_band("山の" * 3000, "やま" * 3000) is None


def test_columns(spark):
    rows = [("柚木 はな", "ユズキ ハナ"), ("見の木", "みのき"), ("木", "き" * 7), ("", ""), ("", "あ"), ("木", ""), (None, "あ"), ("木", None), ("木", "き"), ("木", "き")]
    got = spark.createDataFrame(rows, "b string, r string").select(readings.aligned(F.col("b"), F.col("r")).alias("a")).collect()
    assert [None if r.a is None else [tuple(p) for p in r.a] for r in got] == [
        [("柚", "ユ"), ("木", "ズキ"), ("は", "ハ"), ("な", "ナ")], [("見", "み"), ("の", "の"), ("木", "き")], None, [], None, None, None, None, [("木", "き")], [("木", "き")],
    ]


def test_pairs_of_strings(spark):
    xml = (
        '<sst><si><t>柚木</t><rPh sb="0" eb="2"><t>ユズキ</t></rPh><phoneticPr fontId="1"/></si><si><t>柚木</t></si><si><r><t xml:space="preserve">星 </t></r><r><t>&amp;町</t></r>'
        '<rPh sb="0" eb="1"><t>ホシ</t></rPh>\n<rPh sb="2" eb="3"><t>マチ</t></rPh></si><si><t/><rPh sb="0" eb="0"><t>ア</t></rPh></si></sst><c><is><t>木</t><rPh><t>キ</t></rPh></is></c>'
    )
    got = spark.createDataFrame([(xml,), ("",), (None,)], "x string").select(readings.ruby_pairs(F.col("x")).alias("p")).collect()
    assert [tuple(p) for p in got[0].p] == [("柚木", "ユズキ"), ("星 &町", "ホシマチ"), ("木", "キ")] and got[1].p == [] and got[2].p is None

"""Spelling variants against a comparison of all words, and wavelet trees against a scan of the points."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import spelling


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def expected(words):
    """word: form, root, n, n_near, form_n."""
    forms, rows = {}, {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
        rows[w] = len(around)
    out = {}
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n, rows[w], forms[w] and words[forms[w]])
    return out


def as_rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_points_are_those_of_a_scan():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 300):
        second = rng.permutation(n)
        low, high, least, most = (rng.integers(0, n + 1, 200) for _ in range(4))
        row, found = spelling.Points(second).report(low, high, least, most)
        scanned = [(i, v) for i in range(200) for v in second[low[i] : high[i]] if least[i] <= v < most[i]]
        assert sorted(zip(row.tolist(), found.tolist(), strict=True)) == sorted(scanned)


@pytest.mark.parametrize("part", [spelling.PART, 40])
def test_near_words_of_all_pairs(spark, part):
    """Also with buckets that are split to single positions."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(7, 11))) for _ in range(700)}
    words |= {"a" * 7, "a" * 8, "a" * 9, "b" + "a" * 7, "samestart" + "xyz", *("samestart" + x + y + "z" for x in "abcdef" for y in "abcdef")}
    long = "".join(rng.choice("abc") for _ in range(3000))
    words |= {long, long[:1500] + "x" + long[1501:], long[1:], long + "y", "q" * 2000, "q" * 2001}
    words = {w: rng.choice((2, 3, 20, 25, 300, 4000)) for w in words}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in spelling.near_counts(df, part).collect()}
    want = {}
    for w in words:
        if around := [v for v in words if near(w, v)]:
            best = min(around, key=lambda v: (-words[v], v))
            want[w] = (len(around), best, words[best])
    assert got == want and len(want) > 300


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or 0xC0 <= ord(c) <= 0xFF:
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
                run = ""
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_variants_of_texts(spark):
    rng = random.Random(8)
    bases = ["".join(rng.choice("aeionrstÉé") for _ in range(rng.randrange(5, 12))) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(bases[:4]) if rng.random() < 0.7 else rng.choice(bases).upper() for _ in range(80))) for i in range(120)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (None, "×÷ÀÿĀ Straßenbahn straßenbahn STRASSENBAHN it's"), (500, None), (501, ""), (502, " 1 \n"), (503, ("z" * 30_000 + " ") * 2 + "z" * 29_999), (504, "z" * 30_000), (505, "1234567 Ωmega-words漢字words")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int")
    words = brute_words(rows)
    assert as_rows(spelling.variants(df)) == expected(words) and any(v[0] for v in expected(words).values())


def test_roots_follow_all_forms(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(12)] + [("x", "w05"), ("y", "z")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{w: "w12" for w, _ in chain[:13]}, "y": "z"}


def test_no_documents(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []

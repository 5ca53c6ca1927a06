"""As-of joins, families, lexicons and words near each other against plain versions, with odd rows."""

import random

import pytest

from veilspark.operators import asof, families, lexicon, proximity


@pytest.mark.parametrize("strictly", [False, True])
def test_as_of_equals_a_plain_search(spark, strictly):
    """One key holds most rows; times repeat; keys and times may be null."""
    rng = random.Random(4)
    key = lambda: rng.choice(("hot", "hot", "hot", "a", "b", None))
    at = lambda: rng.choice((None, *range(60)))
    rows = [(key(), at(), i) for i in range(800)]
    past = [(key(), at(), i % 90) for i in range(300)]
    rows += rows[:5]
    left, right = spark.createDataFrame(rows, "k string, at int, n int"), spark.createDataFrame(past, "k string, at int, n int")
    got = asof.as_of(left, right, ["k"], "at", ["n"], strictly).select("k", "at", "n", "found.at", "found.n").collect()
    want = []
    for k, t, n in rows:
        before = [(u, m) for q, u, m in past if k is not None and q == k and None not in (t, u) and (u < t if strictly else u <= t)]
        want.append((k, t, n, *(max(before) if before else (None, None))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and sum(r[3] is not None for r in got) > 300


def test_as_of_without_rows(spark):
    some, none = spark.createDataFrame([("a", 1)], "k string, at int"), spark.createDataFrame([], "k string, at int")
    assert asof.as_of(none, some, ["k"], "at", ["at"]).collect() == []
    assert [tuple(r) for r in asof.as_of(some, none, ["k"], "at", ["at"]).collect()] == [("a", 1, None)]


def test_restaged_and_materials(spark):
    ledger = spark.createDataFrame(
        [("M", 1, "s1", "ok", "t1", "r1"), ("M", 5, "s1", "ok", "t9", "r5"), ("M", 3, "s1", "err", "t1", "rx"), ("M", 9, "s1", "ok", "t1", "r9"), ("M", 8, "s2", "ok", "t2", "r8"), ("S", 2, "t1", "ok", None, "j1")],
        "kind string, at int, h1 string, status string, h2 string, ref string",
    )
    stages = spark.createDataFrame([("t1", 6), ("t2", 6), ("t3", 6), (None, 6)], "stage string, at int")
    assert sorted(map(tuple, asof.restaged(ledger, stages).collect()), key=str) == [("t1", 6, "s1", "r5", 5), ("t2", 6, "s2", None, None)]
    files = spark.createDataFrame([("j1", "t1", "a"), ("j1", "t7", "b"), ("j2", "t1", "c"), ("j2", "t2", "d")], "job string, hash string, name string")
    assert sorted(map(tuple, asof.job_materials(files, ledger).collect())) == [("j1", "t1", "a", False), ("j2", "t1", "c", True), ("j2", "t2", "d", True)]


def roots(rows):
    up = {i: i for i, _ in rows if i is not None}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    first = {}
    for i, keys in rows:
        for k in keys or ():
            if i is not None and k is not None:
                a, b = sorted((top(i), top(first.setdefault(k, i))))
                up[b] = a
    return {(i, top(i)) for i in up}


def test_families_equal_a_plain_search(spark):
    """A long chain, a key of many rows, random keys, repeated rows, nulls."""
    rng = random.Random(7)
    chain = list(range(1000, 1120))
    rng.shuffle(chain)
    rows = [(a, [f"c{i}", f"c{i + 1}"]) for i, a in enumerate(chain)]
    rows += [(2000 + i, ["hot"] if i % 3 else [f"r{rng.randrange(80)}", f"r{rng.randrange(80)}"]) for i in range(200)]
    rows += [(5, None), (6, []), (7, [None]), (8, [None, "x"]), (9, ["x", "x"]), (None, ["x", "hot"]), (9, ["x"])]
    got = families.families(spark.createDataFrame(rows, "id long, keys array<string>"), "id", "keys").collect()
    assert len(got) == len({r.id for r in got}) and {tuple(r) for r in got} == roots(rows)


def test_no_families(spark):
    assert families.families(spark.createDataFrame([], "id long, keys array<string>"), "id", "keys").collect() == []


ENTRIES = [("町", "place"), ("本町", "place"), ("記録", "form"), ("記録", "work"), ("係", "job"), ("", "x"), (None, "x")]


def test_lexicon(spark):
    entries = spark.createDataFrame(ENTRIES, "entry string, kind string")
    words = spark.createDataFrame([(w,) for w in ("東本町", "下町", "町", "訪問記録", "記録", "記録係", "記録用", "柚木", "", None, "柚木", "あ" * 5000 + "町")], "word string")
    assert sorted(map(tuple, lexicon.longest_endings(words, entries).collect())) == sorted([("東本町", "本町", "place"), ("下町", "町", "place"), ("町", "町", "place"), ("訪問記録", "記録", "form"), ("記録", "記録", "form"), ("記録係", "係", "job"), ("あ" * 5000 + "町", "町", "place")])
    assert sorted(map(tuple, lexicon.common_words(words, entries, ("係", "用")).collect())) == sorted([("町", "place"), ("記録", "form"), ("記録係", "form"), ("記録用", "form")])
    kept = lexicon.without_form_words(words.filter("word <> ''").withColumn("n", words.word), entries, spark.createDataFrame([("町",)], "word string"), ("係",))
    assert sorted(r.word for r in kept.collect()) == sorted(["東本町", "下町", "町", "訪問記録", "記録用", "柚木", "柚木", "あ" * 5000 + "町"])
    none = entries.limit(0)
    assert lexicon.longest_endings(words, none).collect() == [] == lexicon.longest_endings(words.limit(0), entries).collect()


def test_other_given_names_across_units(spark):
    """Against all pairs: tokens count over units, null and empty texts between them."""
    rng = random.Random(9)
    vocabulary = ["柚木", "梢田", "朔也", "莉央", "x", "y", "z"]
    people = [("柚木", "朔也"), ("梢田", "莉央"), ("梢田", "朔也")]
    rows = [(d, 0, s, rng.choice((None, "", " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))))) for d in range(6) for s in range(12)]
    rows.append((99, 0, 0, " ".join(["柚木", "莉央"] * 3000)))
    units = spark.createDataFrame(rows, "doc_id long, part_no int, seq int, text string")
    got = proximity.other_given_names(units, spark.createDataFrame(people, "surname string, given string"), r"\S+", 3).collect()
    want = []
    for d in {r[0] for r in rows}:
        tokens = [t for r in rows if r[0] == d for t in (r[3] or "").split()]
        for i, a in enumerate(tokens):
            for j in range(i + 1, min(i + 4, len(tokens))):
                if a in ("柚木", "梢田") and tokens[j] in ("朔也", "莉央") and (a, tokens[j]) not in people:
                    want.append((d, 0, a, i, tokens[j], j))
    columns = ("doc_id", "part_no", "first", "first_pos", "second", "second_pos")
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want) and len(want) > 3000

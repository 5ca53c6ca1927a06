"""Near-dedup by similarity of shingles against brute force, and the pipeline's stage on planted copies."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import components, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_sets(texts):
    words = {i: (t or "").lower().encode().split() for i, t in texts.items()}
    return {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}


def brute_groups(texts, similarity=0.8):
    sets, parent = brute_sets(texts), {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


@pytest.fixture(scope="module")
def planted():
    """30 texts, each with copies in which 2 to 10 words at random places are others: similarities from 0.6 to 0.95."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = {}
    for i in range(30):
        base = [word() for _ in range(220)]
        for k in range(6):
            copy = list(base)
            for at in rng.sample(range(220), 2 * k):
                copy[at] = word()
            texts[10 * i + k] = " ".join(copy)
    for i, t in enumerate([None, "", " \n ", "one two", "One  two", texts[0]]):
        texts[1000 + i] = t
    return texts


def test_stage_removes_planted_near_copies(spark, planted):
    sets = brute_sets(planted)
    near = [len(sets[10 * i] & sets[10 * i + k]) / len(sets[10 * i] | sets[10 * i + k]) for i in range(30) for k in range(1, 6)]
    assert sum(0.8 <= j <= 0.9 for j in near) >= 20 and sum(j < 0.75 for j in near) >= 20
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in planted.items()], DOCS)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(brute_groups(planted).values()))


def test_groups_equal_brute_force(spark):
    """A chain of copies, in which no text is near all others, and rows without or with equal ids."""
    rng = random.Random(7)
    words, texts = [f"w{i}" for i in range(200)], {}
    for i in range(40):
        words[rng.randrange(200)] = f"x{i}"
        texts[i] = " ".join(words)
    rows = [*texts.items(), (None, texts[3]), (5, texts[5]), (50, "far off from all the others here")]
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_groups(texts | {50: rows[-1][1]})
    assert {r["doc_id"]: r["component_id"] for r in got.filter("doc_id is not null").collect()} == want
    assert got.count() == len(rows)


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b, x = ("".join(f"{c}{i} " for i in range(30)) for c in "abx")
    rows = [(1, a), (5, a), (5, b), (7, x), (7, x), (None, a), (None, "alone here"), (9, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_h", F.lit(1)).withColumn("h", F.lit("c")).withColumn("_stays", F.lit(None).cast("int"))
    got = simhash.keepers(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, "alone here"), (1, a), (5, b), (7, x), (8, "")]
    assert simhash.keepers(df.limit(0)).count() == 0


def test_recall_of_blocks(spark):
    """Of pairs at a similarity of about 0.8 nearly all share a block, and chance pairs of no block are rare."""
    rng = np.random.default_rng(3)
    width = simhash.width_for(60_000)
    assert (width, simhash.width_for(10**6), simhash.tables_for(20)) == (20, 24, simhash.TABLES)
    rows, n = [], 300
    for i in range(n):
        base = rng.integers(0, 1 << 63, 360, dtype=np.uint64)
        copy = np.concatenate([base[:320], rng.integers(0, 1 << 63, 40, dtype=np.uint64)])
        for k, h in enumerate((base, copy)):
            rows.append((2 * i + k, 360, simhash.majority(h, simhash.BITS).view("<i8").tolist()))
    keyed = simhash.keyed_by_blocks(spark.createDataFrame(rows, "class long, n int, print array<long>"), width, simhash.TABLES).select("class", "key")
    met = keyed.join(keyed.withColumnRenamed("class", "other"), "key").filter("class < other").select("class", "other").distinct().collect()
    found = sum(r["other"] == r["class"] + 1 and r["class"] % 2 == 0 for r in met)
    assert found >= 0.93 * n
    assert len(met) - found < 0.1 * n * n


def test_bands_meet_similar_sets(spark):
    """Sets at a similarity of 0.8 share a band, those at a third hardly do; their number doesn't grow with the texts."""
    rng, n, far = np.random.default_rng(5), 300, 0
    factors, found = simhash.factors_of_bands(), 0
    for _ in range(n):
        base, new = rng.integers(0, 1 << 63, 360, dtype=np.uint64), rng.integers(0, 1 << 63, 180, dtype=np.uint64)
        bands = [simhash.bands_of(h, factors) for h in (base, np.concatenate([base[:320], new[:40]]), np.concatenate([base[:180], new]))]
        assert all(len(b) == simhash.BANDS for b in bands)
        found += bool((bands[0] == bands[1]).any())
        far += bool((bands[0] == bands[2]).any())
    assert found >= 0.98 * n and far <= 0.05 * n


def test_rows_of_the_largest_group_are_not_crossed(spark, monkeypatch):
    """A block of 200 near classes, which its leader links, two further ones that only another links, and one far off."""
    sides = []
    joined = simhash.skewed_join
    monkeypatch.setattr(simhash, "skewed_join", lambda big, one, *a, **k: sides.append(one) or joined(big, one, *a, **k))
    near = [sum(1 << b for b in bits) for bits in ((i % 16, 16 + i // 16) for i in range(200))]
    classes = [0, *near, near[5] | 0b111 << 40, (1 << 60) - 1]
    keyed = spark.createDataFrame([(1, c) for c in classes], "key long, class long")
    roots = simhash.united(keyed, [], lambda x, y: F.bit_count(F.col(f"{x}.class").bitwiseXOR(F.col(f"{y}.class"))) <= 4)
    assert {r["node"]: r["root"] for r in roots.collect()} == dict.fromkeys(classes[1:-1], 0)
    assert sides[-1].count() == 2


def test_hot_keys_are_counted_over_tables(spark, monkeypatch):
    # Counted over a join with the first side's classes, that join ran twice more.
    texts = [" ".join(f"w{j}" if j else f"x{i}" for j in range(60)) for i in range(40)]
    docs, real, plans = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), simhash.hot_keys, []

    def counted(pairs, keys):
        plans.append(pairs._jdf.queryExecution().analyzed().toString())
        return real(pairs, keys)

    monkeypatch.setattr(simhash, "hot_keys", counted)
    assert {r["component_id"] for r in simhash.similar_groups(docs).collect()} == {0}
    assert plans and not any("Join" in p for p in plans)


def test_rounds_of_few_edges_are_one_task(spark, monkeypatch):
    """Without shuffle and broadcast, which each round made before; with the same stars as over shuffles."""
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(200), rng.randrange(200)) for _ in range(300)], "a long, b long").filter("a <> b")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    for large in (True, False):
        star = components._star(edges, large, 300)
        plan = star._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and star.rdd.getNumPartitions() == 1
        assert key(star) == key(components._star(edges, large, components.EDGES_OF_A_TASK + 1))
    few = key(components.components(edges))
    monkeypatch.setattr(components, "EDGES_OF_A_TASK", 0)
    assert key(components.components(edges)) == few


def test_further_links_extend_roots(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 2000 + i) for i in range(50)]
    rng.shuffle(edges)
    first, later = (spark.createDataFrame(e, "a long, b long") for e in (edges[:170], edges[170:]))
    got = {r["node"]: r["root"] for r in components.extended(components.components(first), later).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {a: b for a, b in root.items() if a != b}
    assert components.extended(components.components(first.limit(0)), later.limit(0)).count() == 0

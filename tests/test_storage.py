"""Joins for skewed keys and ranks within groups."""

from pyspark.sql import functions as F

from veilspark.operators import codebook
from veilspark.storage import clean, hot_keys, kept, ranked_within, skewed_join, work_folder


def test_skewed_join_equals_join(spark):
    big = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1700).alias("k"))
    one = spark.range(0, 1700, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(big, ["k"])
    assert 1 <= hot.count() <= 1024 and hot.filter("k = 0").count() == 1
    for how in ("inner", "left"):
        key = lambda df: sorted(map(str, df.select("id", "k", "v").collect()))
        assert key(skewed_join(big, one, ["k"], F.col("id"), hot, how)) == key(big.join(one, "k", how))


def test_few_hot_keys_are_not_broadcast(spark):
    """Few keys are named in the plan, none leave a plain join, many are broadcast; each equals the join. Before, all were broadcast."""
    big = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(200)).cast("string")).alias("k"))
    one = spark.range(0, 200, 3).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    key = lambda df: sorted(map(str, df.select("id", "k", "v").collect()))
    for n, sent in ((0, False), (1, False), (64, False), (65, True)):
        hot = spark.createDataFrame([(str(i),) for i in range(n)] + [(None,)] * (n == 1), "k string")
        for how in ("inner", "left"):
            joined = skewed_join(big, one, ["k"], F.col("id"), hot, how)
            plan = joined._jdf.queryExecution().analyzed().toString()
            assert ("strategy=broadcast" in plan, "_salt" in plan) == (sent, n > 0)
            assert key(joined) == key(big.join(one, "k", how))


def test_ranks_within_few_large_groups(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("v"), "id")
    rows = sorted(ranked_within(df, "g", ["v", "id"], "n").collect(), key=lambda r: (r["g"], r["v"], r["id"]))
    for g in range(3):
        own = [r["n"] for r in rows if r["g"] == g]
        assert own == list(range(1, len(own) + 1))


def test_codes_of_a_large_book(spark, monkeypatch):
    spans = spark.createDataFrame([(i, 0, 0, 0, "番号", str(10**8 + i % 40 * (i % 2)), "型") for i in range(400)], "doc_id long, part_no int, seq int, st int, kind string, orig string, space string")
    book = codebook.allocate(spans, codebook.empty(spark))
    key = lambda df: sorted((r["doc_id"], r["code"]) for r in df.collect())
    want = key(codebook.with_codes(spans, book))
    monkeypatch.setattr(codebook, "small", lambda df: False)
    assert key(codebook.with_codes(spans, book)) == want


def test_clean_removes_what_was_kept(spark, monkeypatch, tmp_path):
    from veilspark import storage

    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}")
    assert kept(spark.range(3), "x").count() == 3
    folder = tmp_path / work_folder(spark).rpartition("/")[2]
    assert folder.exists() and clean(spark) and not folder.exists()

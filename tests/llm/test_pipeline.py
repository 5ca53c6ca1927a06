"""The pipeline stage by stage on the smallest tables."""

import random
import tracemalloc

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from veilspark.llm import language

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{name}")
        out[name] = (docs, spark.read.parquet(f"file://{folder}/{name}"))
        docs = out[name][1]
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    for before, after in list(stages.values())[:-1]:
        assert after.dtypes == before.dtypes


def test_clean_documents_stay(stages):
    before, after = stages["language_id"]
    assert ids(before) == ids(after)
    before, after = stages["line_dedup"]
    assert ids(before) == ids(after)


def test_one_of_each_group_stays(spark, stages):
    from test_simhash import brute_groups

    before, after = stages["near_dedup"]
    assert ids(after) == sorted(set(brute_groups({r["doc_id"]: r["text"] for r in before.collect()}).values()))


def test_mix_repeats_and_drops(stages):
    before, after = stages["mixing"]
    n = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert max(n.values()) <= 3 and set(n) <= set(ids(before))
    words = lambda df: df.select(F.sum(F.size(F.split(F.trim(F.regexp_replace("text", r"[ \t-\r]+", " ")), " ")))).first()[0]
    assert abs(words(after) - words(before)) < 0.05 * words(before)


def test_pieces_hold_every_copy(stages):
    before, after = stages["packing"]
    assert after.filter("start = 0").count() == before.count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).filter("n > 1024 or n <> end").count() == 0


def test_rejects_what_has_no_language(spark):
    random.seed(1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "12 34", "en", "s", 5), (10**6 + 2, "", "en", "s", 0)], docs.schema)
    got = ids(corpus_pipeline.language_id(spark, docs.unionByName(odd), SF))
    assert got == ids(docs)


def test_odd_rows_pass_all_stages(spark):
    """Null and repeated ids, equal rows, null and very long texts, clashing columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = ["the of and with this that from house water".split(), "der die und nicht mit schön für über straße".split()]
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(40)), ("en", "de")[i % 2], None if i % 7 == 0 else f"s{i % 3}", 0) for i in range(60)]
    rows += [(None, rows[3][1], None, None, None), (5, rows[8][1] + " house water", None, "s1", 0), rows[4], rows[4], (70, None, "en", "s0", 0), (71, "the water of " * 30_000, None, "s2", 0), (72, "", None, None, None)]
    docs = spark.createDataFrame(rows, schema).withColumn("h", F.lit(1)).withColumn("size", F.lit("x")).withColumn("rejected", F.lit(None).cast("int"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        kept[name] = docs.count()
    assert kept["language_id"] == len(rows) - 2 and kept["line_dedup"] == kept["language_id"]
    # Copies of rows 3 and 4, and row 8, which the second row 5 is near to.
    assert kept["near_dedup"] == kept["language_id"] - 4 and kept["packing"] >= kept["mixing"] > 0
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0


def test_training_holds_no_row_of_buckets_for_each_text():
    tracemalloc.start()
    try:
        model = language.train([f"{'wort' if i % 2 else 'mot'} {i % 9} und".encode() for i in range(1000)], [str(i % 2) for i in range(1000)], epochs=1)
        assert tracemalloc.get_traced_memory()[1] < 1000 * language.BUCKETS * 4
    finally:
        tracemalloc.stop()
    assert model.languages == ["0", "1"]

"""Corpus pipeline: language ID, line dedup, near-dedup, mixing and packing, in this order.

Each stage takes the documents that its predecessor kept and returns the columns of documents; the
last returns the packed pieces. Every stage's result is written and read again before the next.

Defined cases: columns beside those of documents are dropped by the first stage. Language ID drops
documents whose text is null or has no letter, and all if none is labelled. Rows that share a doc_id, or
have none, are judged by their own texts; of rows that are equal in all columns near-dedup keeps one.
Mixing repeats a row for each copy that it takes and drops rows of none; a null source is a source, and a
document left without words weighs nothing and stays once. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import language, lines, mixing, packing, simhash
from veilspark.llm.common import kept

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure enough of."""
    return language.identify(docs.select(*DOCUMENT), language.fit(docs)).filter(~F.col("rejected")).select(*DOCUMENT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates; n_chars follows the text."""
    return lines.dedup(docs.select(*DOCUMENT)).select(*DOCUMENT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by five-word shingles at a similarity of 0.8 or more, the document
    with the smallest id."""
    return simhash.keepers(docs.select(*DOCUMENT)).select(*DOCUMENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, or one to three times."""
    mixed = mixing.mix(docs.select(*DOCUMENT).withColumn("size", mixing.size(F.col("text"))))
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*DOCUMENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]
#: SQL can't express a trained model or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, language, lines, mixing, packing, pii, simhash, spelling, substring, topk, warc, whitening
from .common import documents, kept

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(documents(spark, sf_dir)))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
     f AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN f ON f.d = p.d AND p.n >= 1000
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    told = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return told.select("doc_id", (~language.learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = kept(documents(spark, sf_dir).select("doc_id", "source", mixing.size(F.col("text")).alias("size")), "sized")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_dropped")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(documents(spark, sf_dir))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a conversation whose texts are made of the template's control strings."""
    says = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], turns.schema))
    formatted = kept(chat.formatted(chat.paths(*chat.chained(turns))), "formatted")
    return chat.read(formatted).withColumnRenamed("tree", "conv_id").drop("branch")


#: What the template adds to a text, by role; the last is for other roles, beside their names.
ADDED = {role: len(a) + len(b) for role, (a, b) in chat.FORMS.items()}
OP11_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
     e AS (SELECT *, length(regexp_replace(text, '{chat.CONTROL}', '\1\\\2\3', 'g')) AS body, length(regexp_replace(role, '{chat.CONTROL}', '\1\\\2\3', 'g')) AS named FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(body + CASE role {' '.join(f"WHEN '{r}' THEN {n}" for r, n in ADDED.items())} ELSE named + {sum(map(len, chat.NAMED))} END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_substring": op5_substring,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_lines": op8_lines,
    "op9_topk": op9_topk,
    "op10_fingerprint": op10_fingerprint,
    "op11_chat": op11_chat,
    "op12_spelling": op12_spelling,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {"op3_warc": OP3_SQL, "op9_topk": OP9_SQL, "op11_chat": OP11_SQL}

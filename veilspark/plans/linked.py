"""Queries of as-of joins, families, lexicons and words near each other over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, families, lexicon, proximity

#: Days after an order when its stage is looked at.
STAGED = 60


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A masking of a part (source) for an order (stage), reported on the day it was shipped; both by their key, as a
    hash of it is eight times as long."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    report = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return items.select(
        F.lit("M").alias("kind"), F.col("l_shipdate").cast("date").alias("at"), F.col("l_partkey").alias("h1"), F.lit("ok").alias("status"), F.col("l_orderkey").alias("h2"), report.cast("long").alias("ref"),
    )


def restaged_orders(spark, sf_dir):
    """For each order 60 days on: the parts that its hash goes back to, and the last report of each by then."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    stages = orders.select(F.col("o_orderkey").alias("stage"), F.date_add(F.col("o_orderdate").cast("date"), STAGED).alias("at"))
    hashed = lambda what, key: F.sha2(F.concat(F.lit(what), F.col(key).cast("string")), 256).alias(key)
    return asof.restaged(_ledger(spark, sf_dir), stages).select(hashed("order", "stage"), hashed("part", "source"), "report", F.datediff("at", "reported_at").cast("long").alias("age"))


RESTAGED_SQL = f"""
WITH m AS (SELECT l_partkey AS p, CAST(l_shipdate AS DATE) AS d, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS report FROM lineitem),
     s AS (SELECT DISTINCT o_orderkey AS o, l_partkey AS p, CAST(o_orderdate AS DATE) + {STAGED} AS due FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
     f AS (SELECT o, s.p, due, d, report, row_number() OVER (PARTITION BY o, s.p ORDER BY d DESC NULLS LAST, report DESC) AS r FROM s LEFT JOIN m ON s.p = m.p AND d <= due)
SELECT sha256('order' || o) AS stage, sha256('part' || p) AS source, report, CAST(due - d AS BIGINT) AS age FROM f WHERE r = 1
"""


def job_materials(spark, sf_dir):
    """Items of orders as files of jobs; returned ones were sent for the job. A job without any keeps all, guessed."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    files = items.select(F.col("l_orderkey").alias("job"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("hash"), F.col("l_returnflag").alias("name"))
    none = F.lit(None).cast("string")
    sent = items.filter(F.col("l_returnflag") == "R").select(F.lit("S").alias("kind"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("h1"), F.lit("ok").alias("status"), none.alias("h2"), F.col("l_orderkey").alias("ref"))
    return asof.job_materials(files, sent)


MATERIALS_SQL = """
WITH f AS (SELECT l_orderkey AS job, l_orderkey || '-' || l_linenumber AS hash, l_returnflag AS name FROM lineitem),
     o AS (SELECT *, bool_or(name = 'R') OVER (PARTITION BY job, hash) AS own, bool_or(name = 'R') OVER (PARTITION BY job) AS sent FROM f)
SELECT job, hash, name, NOT sent AS guessed FROM o WHERE own OR NOT sent
"""


def customer_families(spark, sf_dir):
    """Customers that share a narrow band of their balance, or nation, segment and a wide one, directly or over others."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    band = lambda width: F.floor(F.col("c_acctbal") / width).cast("string")
    keys = F.array(F.concat_ws("|", F.lit("s"), "c_nationkey", "c_mktsegment", band(500)), F.concat_ws("|", F.lit("b"), band(4)))
    found = families.families(rows.withColumn("keys", keys), "c_custkey", "keys")
    return found.select(F.col("id").alias("c_custkey"), "family")


FAMILIES_SQL = """
WITH RECURSIVE k AS (SELECT c_custkey AS id, 's|' || c_nationkey || '|' || c_mktsegment || '|' || CAST(floor(c_acctbal / 500) AS BIGINT) AS key FROM customer UNION SELECT c_custkey, 'b|' || CAST(floor(c_acctbal / 4) AS BIGINT) FROM customer),
     e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b USING (key)),
     r AS (SELECT c_custkey AS id, c_custkey AS root FROM customer UNION SELECT r.id, e.b FROM r JOIN e ON r.root = e.a)
SELECT id AS c_custkey, min(root) AS family FROM r GROUP BY id
"""

WORD = "[A-Za-z]+"


def word_endings(spark, sf_dir):
    """Words of documents that end in a word of four and more letters of a benchmark item, with the longest one."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word"))
    entries = items.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("entry"))
    return lexicon.longest_endings(words, entries.withColumn("kind", F.left("entry", F.lit(1))))


ENDINGS_SQL = f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}')) AS word FROM documents),
     l AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{{4,}}')) AS entry FROM benchmark),
     s AS (SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda n: right(word, n))) AS entry FROM w),
     b AS (SELECT word, arg_max(entry, length(entry)) AS ending FROM s SEMI JOIN l USING (entry) GROUP BY word)
SELECT word, ending, left(ending, 1) AS kind FROM b
"""
#: Words between a first and a second word of different people.
NEAR = 3


def words_of_other_items(spark, sf_dir):
    """In conversations, across turns: the first word of a benchmark item and, within three words, the last of another."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    units = turns.select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("part_no"), F.col("turn").alias("seq"), F.lower("text").alias("text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w")).filter("size(w) > 1")
    people = items.select(F.element_at("w", 1).alias("surname"), F.element_at("w", -1).alias("given"))
    found = proximity.other_given_names(units, people, "[a-z]+", NEAR)
    return found.select(F.col("doc_id").alias("conv_id"), "first", "first_pos", "second", "second_pos")


OTHERS_SQL = f"""
WITH i AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), p AS (SELECT DISTINCT w[1] AS s, w[-1] AS g FROM i WHERE len(w) > 1),
     u AS (SELECT conv_id, turn, coalesce(regexp_extract_all(lower(text), '[a-z]+'), []) AS w FROM conversations),
     c AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
     t AS (SELECT conv_id, unnest(w) AS token, CAST(before + unnest(range(len(w))) AS BIGINT) AS pos FROM c)
SELECT a.conv_id, a.token AS first, a.pos AS first_pos, b.token AS second, b.pos AS second_pos FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.pos BETWEEN a.pos + 1 AND a.pos + {NEAR}
WHERE a.token IN (SELECT s FROM p) AND b.token IN (SELECT g FROM p) AND NOT EXISTS (SELECT 1 FROM p WHERE p.s = a.token AND p.g = b.token)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"restaged_orders": restaged_orders, "job_materials": job_materials, "customer_families": customer_families, "word_endings": word_endings, "words_of_other_items": words_of_other_items}
ORACLE_SQL: dict[str, str] = {"restaged_orders": RESTAGED_SQL, "job_materials": MATERIALS_SQL, "customer_families": FAMILIES_SQL, "word_endings": ENDINGS_SQL, "words_of_other_items": OTHERS_SQL}

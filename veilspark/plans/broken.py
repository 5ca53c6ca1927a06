"""Queries of entities broken over units, readings, codes in a stream's state and rows handed over once, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codebook, fragments, readings
from ..storage import dealt
from ..streaming import book

#: An invented place, and what each address adds to it.
PLACE, TOWN, HOUSE = "汀野県藍浜市", "帆影町", "凪ハイツ"


def broken_addresses(spark, sf_dir):
    """An address for each customer, over three units, over two with a house, or over units that aren't adjacent."""
    key = F.col("c_custkey").cast("long")
    lot, rest = F.concat((key % 30 + 1).cast("string"), F.lit("丁目")), F.concat(key.cast("string"), F.lit("-"), (key % 9 + 1).cast("string"))
    unit = lambda seq, *parts: F.struct(F.lit(seq).alias("seq"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))
    head = unit(0, F.col("c_mktsegment"), " の記録")
    three = F.array(head, unit(1, "現住所：", PLACE), unit(2, TOWN, lot), unit(3, rest, "　", F.col("c_mktsegment")))
    two = F.array(head, unit(1, "住所：", PLACE, TOWN), unit(2, lot, rest, "　", HOUSE, (key % 90 + 101).cast("string"), "号室"))
    apart = F.array(head, unit(1, "住所：", PLACE), unit(2, TOWN, lot), unit(5, rest))
    chosen = F.when(key % 3 == 1, three).when(key % 3 == 2, two).otherwise(apart)
    units = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("doc_id"), F.lit(0).alias("part_no"), F.explode(chosen).alias("u")).select("doc_id", "part_no", "u.seq", "u.text")
    coded, _ = fragments.coded(fragments.address_pieces(units), codebook.empty(spark))
    return coded.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("st").cast("long").alias("st"), "orig", "code")


BROKEN_SQL = f"""
WITH c AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) AS r FROM customer WHERE c_custkey % 3 <> 0),
     p AS (SELECT k, CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS r, (k % 30 + 1) || '丁目' AS lot, k || '-' || (k % 9 + 1) AS rest FROM c),
     u AS (SELECT *, 1 AS seq, CASE k % 3 WHEN 1 THEN 4 ELSE 3 END AS st, CASE k % 3 WHEN 1 THEN '{PLACE}' ELSE '{PLACE}{TOWN}' END AS orig FROM p
           UNION ALL SELECT *, 2, 0, CASE k % 3 WHEN 1 THEN '{TOWN}' || lot ELSE lot || rest || '　{HOUSE}' || (k % 90 + 101) || '号室' END FROM p
           UNION ALL SELECT *, 3, 0, rest FROM p WHERE k % 3 = 1)
SELECT k AS doc_id, CAST(seq AS BIGINT) AS seq, CAST(st AS BIGINT) AS st, orig, '【住所' || r || CASE WHEN seq = 1 THEN '】' ELSE 'の続き' || (seq - 1) || '】' END AS code FROM u
"""

#: Digits as characters and their readings.
DIGITS = {"0": ("零", "れい"), "1": ("一", "いち"), "2": ("二", "に"), "3": ("三", "さん"), "4": ("四", "よん"), "5": ("五", "ご"), "6": ("六", "ろく"), "7": ("七", "なな"), "8": ("八", "はち"), "9": ("九", "きゅう")}


def reading_parts(spark, sf_dir):
    """Each customer's key as a workbook's string with its reading, and which sounds belong to which digit."""
    def spelt(i: int) -> Column:
        table = F.create_map(*[F.lit(x) for d, both in DIGITS.items() for x in (d, both[i])])
        return F.array_join(F.transform(F.split(F.col("c_custkey").cast("string"), ""), lambda d: table[d]), "の")

    xml = F.concat(F.lit("<si><t>"), spelt(0), F.lit('</t><rPh sb="0" eb="1"><t>'), spelt(1), F.lit("</t></rPh></si>"))
    rows = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")).select("c_custkey", F.explode(readings.ruby_pairs(xml)).alias("p"))
    parts = F.filter(readings.aligned(F.col("p.base"), F.col("p.reading")), lambda p: p["base"] != "の")
    return rows.select("c_custkey", F.posexplode(parts).alias("place", "part")).select("c_custkey", F.col("place").cast("long").alias("place"), F.col("part.base").alias("base"), F.col("part.reading").alias("reading"))


READINGS_SQL = f"""
WITH d AS (SELECT c_custkey, unnest(range(length(CAST(c_custkey AS VARCHAR)))) AS place, CAST(CAST(c_custkey AS VARCHAR)[place + 1] AS INT) AS n FROM customer)
SELECT c_custkey, CAST(place AS BIGINT) AS place, [{", ".join(f"'{b}'" for b, _ in DIGITS.values())}][n + 1] AS base, [{", ".join(f"'{r}'" for _, r in DIGITS.values())}][n + 1] AS reading FROM d
"""


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def streamed_codes(spark, sf_dir):
    """Codes of the customers of a stream of orders, given by counters in its state."""
    zero = F.lit(0)
    spans = stream_of(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), zero.alias("part_no"), zero.alias("seq"), zero.alias("st"), F.lit("利用者").alias("kind"), F.concat(F.lit("Customer-"), F.col("o_custkey").cast("string")).alias("orig"))
    return book.run(book.coded(spans)).select("doc_id", "orig", "code", "new")


CODES_SQL = f"""
WITH o AS (SELECT o_orderkey AS doc_id, 'Customer-' || o_custkey AS orig FROM orders WHERE o_custkey IS NOT NULL),
     p AS (SELECT *, CAST('0x' || left(md5(orig), 7) AS BIGINT) % {book.PARTS} AS part, min(doc_id) OVER (PARTITION BY orig) AS first FROM o),
     n AS (SELECT *, (dense_rank() OVER (PARTITION BY part ORDER BY first) - 1) * {book.PARTS} + part + 1 AS n FROM p)
SELECT doc_id, orig, '【利用者' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END || '】' AS code, doc_id = first AS new FROM n
"""


def rows_handed_over(spark, sf_dir):
    """What users did, from a stream of events, handed over once by content."""
    return book.run(book.handed_over(stream_of(spark, sf_dir, "events").select("user_id", "event_type")), name="handed")


HANDED_SQL = """
SELECT DISTINCT user_id, event_type, sha256('{"user_id":' || coalesce(CAST(user_id AS VARCHAR), 'null') || ',"event_type":' || coalesce('"' || event_type || '"', 'null') || '}') AS content_hash FROM events
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"broken_addresses": broken_addresses, "reading_parts": reading_parts, "streamed_codes": streamed_codes, "rows_handed_over": rows_handed_over}
ORACLE_SQL: dict[str, str] = {"broken_addresses": BROKEN_SQL, "reading_parts": READINGS_SQL, "streamed_codes": CODES_SQL, "rows_handed_over": HANDED_SQL}

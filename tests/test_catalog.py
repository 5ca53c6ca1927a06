"""Each query of the catalog against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from veilspark.plans import cases, catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - set(cases.ORACLE_SQL)))
def test_against_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = db.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda rows: sorted(str(r) for r in rows)
    assert key(tuple(r) for r in df.select(*columns).collect()) == key(cursor.fetchall())


def width(text):
    return sum(2 if c == "\t" else 0.5 if " " <= c <= "~" or "｡" <= c <= "ﾟ" else 1 for c in text)


def texts(db):
    return db.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall()


def test_pages_equal_a_plain_count(spark, db):
    want = []
    for doc_id, text in texts(db):
        pages, used = [], 0
        for p in text.split("\n"):
            cost = max(1, math.ceil(width(p) / 48))
            if pages and used + cost <= (33 if len(pages) == 1 else 32):
                pages[-1] += 1
                used += cost
            else:
                pages.append(1)
                used = cost
        want += [(doc_id, i, n) for i, n in enumerate(pages, 1)]
    assert sorted(tuple(r) for r in catalog.QUERIES["pages_of_documents"](spark, SF).collect()) == sorted(want)


def test_chunks_equal_a_plain_count(spark, db):
    want = []
    for doc_id, text in texts(db):
        pieces = [q for p in text.split("\n") for q in ([p[i : i + 640] for i in range(0, len(p), 640)] or [""])]
        chunks = []
        for q in pieces:
            lines = max(1, math.ceil(width(q) / 32))
            if chunks and chunks[-1][0] + lines <= 20:
                chunks[-1] = (chunks[-1][0] + lines, chunks[-1][1] + 1)
            else:
                chunks.append((lines, 1))
        want += [(doc_id, i, *c) for i, c in enumerate(chunks)]
    assert sorted(tuple(r) for r in catalog.QUERIES["chunks_of_documents"](spark, SF).collect()) == sorted(want)


def test_no_suspects_in_texts_without_kanji(spark):
    assert catalog.QUERIES["suspects_of_documents"](spark, SF).filter("rule not in ('field cell', 'field')").count() == 0


def test_pages_fit(spark):
    from pyspark.sql import functions as F

    from veilspark.functions.text import line_cost
    from veilspark.operators.records import paginated

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("record_id"), F.split("text", "\n").alias("paras"))
    pages = paginated(docs)
    cost = pages.select("record_id", "page", F.size("paras").alias("n"), F.aggregate("paras", F.lit(0), lambda a, p: a + line_cost(p)).alias("lines"))
    assert cost.filter("n > 1 and lines > 33").count() == 0
    assert pages.agg(F.sum(F.size("paras"))).first()[0] == docs.agg(F.sum(F.size("paras"))).first()[0]

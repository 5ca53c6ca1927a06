"""Steps whose cost must grow with the rows and not faster: parts, batches, broadcasts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark import storage
from veilspark.functions import patterns
from veilspark.operators import asof, codebook, registry, suspect_rules
from veilspark.plans import broken, cases, linked
from veilspark.sources import batches, ooxml, tables


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """A folder with a table of many customers in one small file."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.range(1, 40_001, numPartitions=1).withColumnRenamed("id", "c_custkey").write.parquet(f"{folder}/customer.parquet")
    return folder


def parts(df) -> int:
    """Parts that hold rows."""
    return df.groupBy("p").count().count()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_delimited_files_are_dealt_and_batched(spark, customers):
    keys = cases.Given(spark, customers).keys
    assert keys.count() == 40_000 and parts(keys.select(F.spark_partition_id().alias("p"))) >= 4
    rows = ((str(i), i, "utf-8", ["a", None], None) for i in range(10_000))
    made = list(batches.together(rows, tables.SCHEMA))
    assert [b.num_rows for b in made] == [4096, 4096, 1808] and pa.Table.from_batches(made).column("n").to_pylist() == list(range(10_000))
    assert len(list(batches.together(((str(i), i, None, ["x" * (9 << 20)], None) for i in range(4)), tables.SCHEMA))) == 2


def test_near_names_send_nothing_over_the_driver(spark):
    words, surfaces = spark.createDataFrame([("柚本朔也",), ("柚木朔也",), ("柚木朔",)], "word string"), spark.createDataFrame([("柚木朔也",)], "surface string")
    near = registry.near_names(words, surfaces)
    assert "BroadcastHashJoin" not in plan(near) and [tuple(r) for r in near.collect()] == [("柚本朔也", "柚木朔也", 1)]


def test_packages_are_rewritten_in_many_parts(spark):
    files = spark.createDataFrame([(i, bytearray(ooxml.simple_document("題", ["次"]))) for i in range(100)], "doc_id long, content binary")
    new = ooxml.rewritten_documents(files, spark.createDataFrame([(i, 1, "新") for i in range(100)], "doc_id long, seq int, text string"))
    assert "BroadcastHashJoin" not in plan(new) and new.select(F.spark_partition_id()).distinct().count() == 4
    assert ooxml.document_units(new).filter("text = '新'").count() == 100


@pytest.mark.parametrize("join", ["spread", "dimension", "skewed"])
def test_large_sides_are_not_broadcast(spark, monkeypatch, join):
    monkeypatch.setattr(storage, "small", lambda df, rows=0: False)
    big, one = spark.createDataFrame([(1, 2)], "k long, id long"), spark.createDataFrame([(1, 3)], "k long, v long")
    met = {
        "spread": lambda: storage.spread_join(big, one, ["k"], F.col("id")), "dimension": lambda: storage.dimension_join(big, one, "k"),
        "skewed": lambda: storage.skewed_join(big, one, ["k"], F.col("id"), spark.createDataFrame([(1,)], "k long"), wide=True),
    }[join]()
    assert "SortMergeJoin" in plan(met) and met.collect() == [(1, 2, 3)]


def test_as_of_writes_keys_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(asof, "kept", lambda df, what: written.append(df) or storage.kept(df, what))
    rows, past = spark.createDataFrame([("a", 2, 7), ("b", 1, 8)], "k string, at int, n int"), spark.createDataFrame([("a", 1, 5)], "k string, at int, r int")
    got = asof.as_of(rows, past, ["k"], "at", ["r"]).orderBy("n").collect()
    assert [tuple(r[:3]) for r in got] == [("a", 2, 7), ("b", 1, 8)] and tuple(got[0]["found"]) == ("a", 1, 5) and got[1]["found"] is None
    assert all("k" not in written[0].schema[c].dataType.names for c in ("_row", "_past"))


def test_readings_are_dealt(spark, customers):
    assert "REPARTITION_BY_NUM" in plan(broken.reading_parts(spark, customers))


def test_no_text_is_cast_in_vain_and_texts_are_cut_at_a_sign(spark):
    texts = ["昭和9年1月2日、S.30.4.5、1964/7/8、1966/7/8", "\x1e1964/7/8\x1eと1930/1/2", "なし", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    old = next(s for s in patterns.SHAPES if s.kind == "古い日付")
    got = df.select("i", patterns.shape_spans(F.col("text"), old).alias("s"), patterns.pieces(F.col("text"), "(?=1)").alias("p"))
    assert "try_cast" not in plan(got.select("s"))
    rows = {r["i"]: r for r in got.collect()}
    assert {i: [(s["st"], s["orig"]) for s in r["s"]] for i, r in rows.items()} == {0: [(0, "昭和9年1月2日"), (9, "S.30.4.5"), (18, "1964/7/8")], 1: [(1, "1964/7/8"), (11, "1930/1/2")], 2: [], 3: [], 4: []}
    assert rows[1]["p"] == ["\x1e", "1964/7/8\x1eと", "1930/", "1/2"] and rows[2]["p"] == ["なし"] and rows[3]["p"] == [""]


@pytest.mark.parametrize("query", ["nearest_people", "colliding_renames"])
def test_rows_of_many_keys_are_not_broadcast(spark, customers, query):
    # Their size is guessed from the keys, before each becomes several rows.
    assert "BroadcastExchange" not in plan(cases.QUERIES[query](spark, customers))


ORIGINALS = ("12345678", "1234567890123456", "a.b@c.example", "the.given.name.of.somebody@c.example", "03-1234-5678", "昭和15年3月2日", "99年9月", "x@y.zz", "1@b.example")


@pytest.mark.parametrize("few", [True, False])
def test_gate_makes_rows_of_runs_with_a_sign_only(spark, monkeypatch, few):
    met, join = [], codebook.salted_join
    monkeypatch.setattr(codebook, "small", lambda df: few)
    monkeypatch.setattr(codebook, "salted_join", lambda big, *a, **kw: met.append(big) or join(big, *a, **kw))
    rest = "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(4_000))
    texts = [*ORIGINALS, *(f"{o}{rest}" for o in ORIGINALS), *(f"{rest}9{o}1{rest}" for o in ORIGINALS), rest + "".join(ORIGINALS), "\x1e".join(ORIGINALS), "1234567", "", None, rest]
    rows = spark.createDataFrame([(i, 0, 0, t) for i, t in enumerate(texts)], "doc_id long, part_no int, seq int, masked string")
    book = spark.createDataFrame([(f"型|番号|{o}", "番号", i, f"【番号{i:03}】", o, o, False, False) for i, o in enumerate(ORIGINALS)], codebook.SCHEMA)
    got = codebook.leftovers(rows, book).filter(F.col("orig").isin(*ORIGINALS))
    assert {(r["doc_id"], r["orig"]) for r in got.collect()} == {(i, o) for i, t in enumerate(texts) for o in ORIGINALS if len(o) >= 6 and o in (t or "")}
    # Were each character a row, they would be some 80,000.
    assert len(met) == (not few) and all(df.count() < 5_000 for df in met)


@pytest.mark.parametrize("hot_rows, tables", [(0, 2), (150, 2), (10_000, 1)])
def test_as_of_deals_hot_keys_only_by_range(spark, monkeypatch, hot_rows, tables):
    written = []
    monkeypatch.setattr(asof, "kept", lambda df, what: written.append(df) or storage.kept(df, what))
    monkeypatch.setattr(asof, "HOT_ROWS", hot_rows)
    key = lambda i: "hot" if i % 3 else f"k{i % 7}"
    rows, past = [(key(i), i * 31 % 100, i) for i in range(600)], [(key(i), i * 17 % 100, i) for i in range(0, 300, 2)]
    left, right = spark.createDataFrame(rows, "k string, at int, n int"), spark.createDataFrame(past, "k string, at int, r int")
    got = {r["n"]: r["found"] and tuple(r["found"]) for r in asof.as_of(left, right, ["k"], "at", ["r"]).collect()}
    want = {n: max(((k, t, r) for k, t, r in past if k == q and t <= at), key=lambda p: p[1:], default=None) for q, at, n in rows}
    assert got == want and len(written) == tables
    # Keys and times stand there once, beside what else the two tables have.
    assert written[0].columns == ["_k0", "_at", "_side", "_past", "_row"] and [written[0].schema[c].dataType.names for c in ("_past", "_row")] == [["r"], ["n"]]


def test_orders_are_staged_by_key_and_met_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(asof, "kept", lambda df, what: written.append(df) or storage.kept(df, what))
    df = linked.restaged_orders(spark, "/root/testdata/sf0.001")
    assert dict(written[0].dtypes)["_k0"] == "bigint" and "_row:struct<stage:bigint>" in written[0]._jdf.schema().simpleString()
    # What was met is read from the table; the orders aren't read again for those without a key.
    assert "Join" not in plan(df) and df.count() > 0


def test_known_words_and_texts_of_the_gate_are_not_broadcast(spark, customers, monkeypatch):
    # Titles become words, and keys become texts, of which the guessed size knows nothing.
    assert "Broadcast" not in plan(cases.QUERIES["suspects_by_rule"](spark, customers))
    units = lambda text: spark.range(1, 4).select(F.col("id").alias("doc_id"), F.lit(0).alias("part_no"), F.lit(0).alias("seq"), F.replace(F.lit(text), F.lit("~"), F.col("id").cast("string")).alias("text"))
    jobs = suspect_rules.jobs_with_names(units("主任：例田、例田さんと主任：他田~"))
    assert "Broadcast" not in plan(jobs) and sorted((r["doc_id"], r["word"]) for r in jobs.collect()) == [(i, "例田") for i in (1, 2, 3)]
    monkeypatch.setattr(codebook, "small", lambda df: False)
    book = spark.range(2, 4).select(F.concat(F.lit("型|番号|1234567"), "id").alias("key"), F.concat(F.lit("1234567"), "id").alias("orig"))
    left = codebook.leftovers(units("登録A1234567~号"), book, "text")
    assert "Broadcast" not in plan(left) and sorted((r["doc_id"], r["orig"]) for r in left.collect()) == [(2, "12345672"), (3, "12345673")]

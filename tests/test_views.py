"""Views, raw markup and dictionaries against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.operators import automaton, markup, views


def pieces(df, pattern, found):
    spans = views.mapped(F.col("view"), views.matched(F.col("view"), found))
    return {r["id"]: r["p"] for r in views.with_view(df, pattern).select("id", F.transform(spans, lambda s: F.substring(F.col("text"), s["st"] + 1, s["en"] - s["st"])).alias("p")).collect()}


def test_numbers_in_groups(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("123 -\nx") for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "12 34-56 78", "1234\n5678", "1 " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("view", F.lit("clash"))
    runs = [re.findall(r"[0-9]+(?:[ \n-]+[0-9]+)*", t) if t is not None else None for t in texts]
    want = [None if r is None else [x for x in r if len(re.sub("[^0-9]", "", x)) >= 8 and "\n" not in x] for r in runs]
    got = pieces(df, views.GROUPED, "[0-9]{8,}")
    assert [(i, got[i], w) for i, w in enumerate(want) if got[i] != w] == [] and sum(map(len, filter(None, want))) > 10


def test_references_are_taken_whole(spark):
    df = spark.createDataFrame([(0, "x a&#64;b&#x2e;example y"), (1, "a&amp;b"), (2, "&#64;"), (3, "a@b.example&amp;"), (4, "q&#55296;&#99999999;@")], "id int, text string")
    assert pieces(df, views.REFERENCE, r"[a-z]+@[a-z.]+") == {0: ["a&#64;b&#x2e;example"], 1: [], 2: [], 3: ["a@b.example"], 4: []}
    assert pieces(df, views.REFERENCE, "[@&]+")[2] == ["&#64;"] and pieces(df, views.REFERENCE, "[@&]+")[1] == ["&amp;"]


def test_headers_keep_their_codes(spark):
    rows = [('&L&"Gothic,Bold"柚&12木 朔也&R&P', '&L&"Gothic,Bold"<N>&12&R&P'), ("&L柚木&R朔也", "&L柚木&R朔也"), ("A&&B 柚木朔也", "A&&B <N>"), ("", ""), (None, None), ("&K00FF00柚木朔也柚木朔也", "&K00FF00<N><N>")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id int, text string")
    assert {r["id"]: r["masked"] for r in views.header_masked(df, "柚木 ?朔也", "<N>").collect()} == {i: w for i, (_, w) in enumerate(rows)}


MARKUP = [
    ("<p>a@b.xy</p>", "<p>M</p>"), ('<a href="a@b.xy">c&#64;d.xy</a>', '<a href="a@b.xy">M</a>'), ("<!-- a@b.xy --><script>a@b.xy</script><style>a@b.xy</style>", None), ("<!-- a@b.xy", None), ("2 < 3 a@b.xy <3", "2 < 3 M <3"),
    ("<![CDATA[a@b.xy]]>a@b.xy,a@b.xy", "<![CDATA[a@b.xy]]>M,M"), ("<p title='>a@b.xy'>x", None), ("", None), (None, None), ("<SCRIPT >a@b.xy</SCRIPT >a@b.xy", "<SCRIPT >a@b.xy</SCRIPT >M"), ("<" + "x " * 20_000 + ">" + "y" * 50_000 + " a@b.xy", "<" + "x " * 20_000 + ">" + "y" * 50_000 + " M"),
]


def test_markup_is_masked_in_texts_only(spark):
    df = spark.createDataFrame([(i, t, "k", 0) for i, (t, _) in enumerate(MARKUP)] + [(0, MARKUP[0][0], "k", 0), (None, "a@b.xy", "k", 0)], "id int, html string, k string, at int")
    done = markup.masked(df, "id", "html", r"(?<![a-z])[a-z]++@[a-z.]+", "M", "@|&#")
    got = done.collect()
    assert len(got) == len(MARKUP) + 2
    assert {r["id"]: r["masked"] for r in got} == {**{i: t if w is None else w for i, (t, w) in enumerate(MARKUP)}, None: "M"}
    code = markup.masked(df, "id", "html", r"(?<![a-z])[a-z]++@[a-z.]+", "[*]", "@|&#").select("id", markup.restored(F.col("masked"), "[*]", F.col("found")).alias("back"))
    assert {r["id"]: r["back"] for r in code.collect()} == {**{i: t for i, (t, _) in enumerate(MARKUP)}, None: "a@b.xy"}


@pytest.mark.parametrize("part", [automaton.PART, 7])
def test_words_of_a_dictionary(spark, part):
    """Also with a dictionary in several automata."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(40)}
    texts = ["".join(rng.choice("abéx😀") for _ in range(rng.randrange(40))) for _ in range(100)] + [None, "", "ab" * 10_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, found string")
    found = automaton.occurrences(df, spark.createDataFrame([(w,) for w in [*words, *words, None, ""]], "word string"), part=part)
    got = {r["id"]: ([tuple(s) for s in r["found"]], [tuple(s) for s in r["chosen"]]) for r in found.withColumn("chosen", automaton.longest(F.col("found"))).collect()}
    for i, t in enumerate(texts):
        every = [(a, a + n) for a in range(len(t or "")) for n in range(1, 5) if t[a : a + n] in words and a + n <= len(t)]
        chosen, at = [], 0
        for a in sorted({s for s, _ in every}):
            if a >= at:
                at = max(e for s, e in every if s == a)
                chosen.append((a, at))
        assert got[i] == (sorted(every), chosen)


def test_no_dictionary(spark):
    df = spark.createDataFrame([("x",)], "text string")
    assert automaton.occurrences(df, spark.createDataFrame([], "word string")).first()["found"] == []


def test_ampersands_of_broken_references_are_in_no_finding(spark, tmp_path):
    import duckdb

    from veilspark.plans import marked

    pages = [(1, "<title>les&amp;&amp</title>a@b.com"), (2, "<p>loud&amp;&amp;&</p>"), (3, "<p>loud&amp;&amp;&amp</p>"), (4, "<p>loud&&amp;&amp;x</p>"), (5, "loud&amp;&amp;")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in marked.masked_pages(spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert got == set(con.execute(marked.PAGES_SQL).fetchall())

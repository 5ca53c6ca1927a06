"""The library's queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.patterns import SHAPES, candidates, located, shape_spans
from ..operators import adjacent, cells, codebook, lineage, lookup, mask, records, registry, spans, suspects
from ..storage import kept
from . import broken, cases, linked, marked

Query = Callable[[SparkSession, str], DataFrame]
SHAPE = {s.kind: s for s in SHAPES}
MAIL, NUMBER, PHONE, POSTAL = "メール", "番号", "電話", "郵便番号"
#: Words whose documents are flagged, as the dose and drug words are.
FLAG_WORDS = ("password", "license", "version", "threat", "stupid", "clown")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units: one part, one unit for a document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("part_no"), F.lit(0).alias("seq"), "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as units: a unit for a turn."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("part_no"), F.col("turn").cast("int").alias("seq"), "role", "text")


def mail_spans(spark, sf_dir):
    rows = units(spark, sf_dir).filter(F.col("text").contains("@")).select("doc_id", F.explode(shape_spans(F.col("text"), SHAPE[MAIL])).alias("s"))
    return rows.select("doc_id", F.col("s.st").cast("long").alias("st"), F.col("s.orig").alias("orig"))


def number_spans(spark, sf_dir):
    rows = units(spark, sf_dir).select("doc_id", F.explode(shape_spans(F.col("text"), SHAPE[NUMBER])).alias("s"))
    return rows.select("doc_id", F.col("s.st").cast("long").alias("st"), F.col("s.orig").alias("orig"))


_SPANS_SQL = """
WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '{r}') AS v, regexp_split_to_array(text, '{r}') AS g FROM documents),
     e AS (SELECT doc_id, v, g, unnest(range(1, len(v) + 1)) AS i FROM m WHERE len(v) > 0)
SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS st, v[i] AS orig FROM e
"""
MAIL_RE, NUMBER_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "[0-9０-９]{8,}"


def overlap_fold(spark, sf_dir):
    """Candidates of phone, postal code and number, resolved greedily."""
    text = F.col("text")
    found = spans.fold(candidates(text, (PHONE, POSTAL, NUMBER)), text)
    rows = units(spark, sf_dir).select("doc_id", F.explode(found).alias("s"))
    return rows.select("doc_id", F.col("s.kind").alias("kind"), F.count("*").over(W.partitionBy("doc_id", "s.kind")).alias("n"), F.length("s.orig").alias("n_chars")).groupBy("doc_id", "kind").agg(F.max("n").alias("n"), F.sum("n_chars").alias("n_chars"))


FOLD_SQL = """
WITH b AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([^0-9０-９-])', '\\1\\1', 'g'), '(?:^|[^0-9０-９])([0-9]{3}-[0-9]{4}|[0-9０-９]{8,})(?:$|[^0-9０-９])', 1) AS v FROM documents),
     e AS (SELECT doc_id, unnest(v) AS o FROM b)
SELECT doc_id, CASE WHEN o LIKE '%-%' THEN '郵便番号' ELSE '番号' END AS kind, count(*) AS n, CAST(sum(length(o)) AS BIGINT) AS n_chars FROM e GROUP BY 1, 2
"""


def mail_codebook(spark, sf_dir):
    """Codes of all mail addresses, numbered by first appearance."""
    found = mask.find_spans(units(spark, sf_dir), (MAIL,))
    return codebook.allocate(found, codebook.empty(spark)).select("orig", "n", "code")


CODEBOOK_SQL = f"""
WITH s AS ({_SPANS_SQL.format(r=MAIL_RE)}),
     f AS (SELECT orig, min(struct_pack(d := doc_id, p := st)) AS first FROM s GROUP BY orig),
     r AS (SELECT orig, row_number() OVER (ORDER BY first) AS n FROM f)
SELECT orig, n, '【メール' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END || '】' AS code FROM r
"""


def _masked_mails(spark, sf_dir):
    rows = units(spark, sf_dir)
    found = mask.find_spans(rows, (MAIL, NUMBER))
    delta = kept(codebook.allocate(found, codebook.empty(spark)), "codebook")
    return rows, found, delta


def mask_restore(spark, sf_dir):
    """Mask mails and numbers, restore them, and compare with the original."""
    out = mask.mask(units(spark, sf_dir), codebook.empty(spark), (MAIL, NUMBER))
    back = codebook.restore(out.units.select("doc_id", "part_no", "seq", "text", "masked"), out.delta, "masked")
    return back.select("doc_id", F.regexp_count("masked", F.lit("【[^【】]{1,40}】")).cast("long").alias("n_codes"), (F.col("restored") == F.col("text")).alias("equal"), F.size("unknown").cast("long").alias("n_unknown"))


MASK_SQL = f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '{MAIL_RE}')) + len(regexp_extract_all(regexp_replace(text, '{MAIL_RE}', '@', 'g'), '{NUMBER_RE}')) AS BIGINT) AS n_codes,
       true AS equal, CAST(0 AS BIGINT) AS n_unknown FROM documents
"""


def replacement_counts(spark, sf_dir):
    """How often each mail was replaced in each document."""
    found = mask.find_spans(units(spark, sf_dir), (MAIL,))
    book = kept(codebook.allocate(found, codebook.empty(spark)), "codebook")
    return mask.replacement_counts(codebook.with_codes(found, book)).select("doc_id", "orig", "code", "n")


COUNTS_SQL = f"""
SELECT doc_id, s.orig, code, count(*) AS n FROM ({_SPANS_SQL.format(r=MAIL_RE)}) s JOIN ({CODEBOOK_SQL}) c ON s.orig = c.orig GROUP BY ALL
"""


def leftover_gate(spark, sf_dir):
    """Unmasked documents against the codebook of all mails and numbers: what the gate must find, also
    inside other words."""
    rows, _, book = _masked_mails(spark, sf_dir)
    return codebook.leftovers(rows, book, "text").groupBy("doc_id").agg(F.count("*").alias("n_left"))


LEFT_SQL = f"""
WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(regexp_replace(text, '{MAIL_RE}', '@', 'g'), '{NUMBER_RE}')) AS orig FROM documents),
     o AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{MAIL_RE}')) AS orig FROM documents UNION SELECT orig FROM n WHERE replace(orig, orig[1], '') <> '')
SELECT doc_id, count(*) AS n_left FROM documents JOIN o ON contains(text, orig) GROUP BY doc_id
"""


def document_status(spark, sf_dir):
    """Status of each document: numbers hold it, mails of an unknown domain reject it."""
    rows = units(spark, sf_dir)
    found = mask.find_spans(rows, (MAIL, NUMBER))
    held = found.filter(F.col("kind") == NUMBER)
    left = found.filter((F.col("kind") == MAIL) & ~F.col("orig").rlike(r"example\.com$"))
    return mask.file_status(rows, found, held, left)


STATUS_SQL = f"""
WITH m AS ({_SPANS_SQL.format(r=MAIL_RE)}), n AS (SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '{MAIL_RE}', '@', 'g'), '{NUMBER_RE}')) AS k FROM documents),
     a AS (SELECT doc_id, count(*) AS mails, count(*) FILTER (WHERE NOT ends_with(orig, 'example.com')) AS bad FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(mails, 0) + k AS BIGINT) AS n_repl, CAST(k AS BIGINT) AS n_sus, CAST(coalesce(bad, 0) AS BIGINT) AS n_left,
       CASE WHEN coalesce(bad, 0) > 0 THEN 'err' WHEN k > 0 THEN 'held' ELSE 'ok' END AS status
FROM documents d JOIN n USING (doc_id) LEFT JOIN a USING (doc_id)
"""


def flagged_documents(spark, sf_dir):
    """Documents with at least two of the flag words."""
    seen = [F.col("text").contains(w).cast("int") for w in FLAG_WORDS]
    return units(spark, sf_dir).select("doc_id", sum(seen[1:], seen[0]).cast("long").alias("n_words")).filter("n_words >= 2")


FLAG_SQL = "SELECT doc_id, n_words FROM (SELECT doc_id, CAST(" + " + ".join(f"CAST(contains(text, '{w}') AS INT)" for w in FLAG_WORDS) + " AS BIGINT) AS n_words FROM documents) WHERE n_words >= 2"


def duplicate_texts(spark, sf_dir):
    """Texts that occur more than once apart from white space: the smallest id stands for them."""
    key = F.sha2(F.regexp_replace("text", "[ \t\n\r]+", ""), 256)
    return units(spark, sf_dir).groupBy(key.alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1")


DUPLICATE_SQL = "SELECT sha256(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g')) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1"


def nearest_turn(spark, sf_dir):
    """For each turn the nearest turn of the role `user` in its conversation, at most 3 away."""
    rows = turns(spark, sf_dir)
    mentions = rows.filter("role = 'user'").select("doc_id", "seq", F.col("seq").cast("string").alias("person")).distinct()
    found = registry.nearest_person(rows.select("doc_id", "seq").distinct(), mentions)
    return found.select("doc_id", "seq", F.col("person").cast("int").alias("nearest"), "distance")


NEAREST_SQL = """
WITH t AS (SELECT DISTINCT conv_id AS doc_id, CAST(turn AS INTEGER) AS seq FROM conversations), u AS (SELECT DISTINCT conv_id AS doc_id, CAST(turn AS INTEGER) AS s FROM conversations WHERE role = 'user')
SELECT doc_id, seq, s AS nearest, CAST(abs(s - seq) AS INTEGER) AS distance FROM t JOIN u USING (doc_id) WHERE abs(s - seq) <= 3
QUALIFY row_number() OVER (PARTITION BY doc_id, seq ORDER BY abs(s - seq), s DESC) = 1
"""


def previous_turn(spark, sf_dir):
    """Turns whose directly preceding turn ends with a question mark or period."""
    rows = adjacent.with_previous(turns(spark, sf_dir).dropDuplicates(["doc_id", "seq"]))
    return rows.filter(F.col("before").rlike(r"[.?]$")).select("doc_id", "seq", F.length("before").cast("long").alias("n_before"))


PREVIOUS_SQL = """
WITH t AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS seq, any_value(text) AS text FROM conversations GROUP BY ALL),
     l AS (SELECT doc_id, seq, lag(seq) OVER w AS p, lag(text) OVER w AS b FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
SELECT doc_id, seq, length(b) AS n_before FROM l WHERE p = seq - 1 AND regexp_matches(b, '[.?]$')
"""


def valid_orders(spark, sf_dir):
    """Per customer the order valid on a day (60 days from its date), else the newest."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("start"))
    found = lookup.valid_or_newest(orders.withColumn("end", F.date_add("start", 60)).select("o_custkey", "start", "end", F.col("o_orderkey").alias("id")), ["o_custkey"], F.lit("1997-01-15").cast("date"))
    return found.select("o_custkey", "start", "valid", "why", "n_rows")


VALID_SQL = """
WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 60 AS "end" FROM orders),
     v AS (SELECT *, start <= DATE '1997-01-15' AND DATE '1997-01-15' <= "end" AS valid, count(*) OVER (PARTITION BY o_custkey) AS n_rows FROM o)
SELECT o_custkey, start, valid, CASE WHEN valid THEN NULL WHEN start > DATE '1997-01-15' THEN 'not started' ELSE 'expired' END AS why, n_rows
FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY valid DESC, start DESC) = 1
"""


def formula_closure(spark, sf_dir):
    """Cells made of part keys, each a formula of the cell at half its number: what reaches the first three."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).filter("k > 0").distinct()
    made = part.select(F.lit(1).cast("long").alias("doc_id"), F.lit("S").alias("sheet"), F.concat(F.lit("A"), F.col("k")).alias("ref"), F.when(F.col("k") > 3, F.concat(F.lit("=$A$"), F.floor(F.col("k") / 2), F.lit("+1"))).alias("formula"))
    targets = spark.createDataFrame([("S", f"A{i}", "label") for i in (1, 2, 3)], "sheet string, ref string, label string")
    return cells.registered(made, targets).select("ref", F.col("round").cast("int").alias("round"))


CLOSURE_SQL = """
WITH RECURSIVE p AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_partkey > 0),
     c(k, round) AS (SELECT k, 0 FROM p WHERE k <= 3 UNION ALL SELECT p.k, round + 1 FROM c JOIN p ON p.k // 2 = c.k AND p.k > 3 WHERE round < 6)
SELECT 'A' || k AS ref, CAST(min(round) AS INTEGER) AS round FROM c GROUP BY k
"""


def _ledger(spark, sf_dir):
    """Parts by quantity as sources, orders as stages, customers as jobs."""
    m = table(spark, sf_dir, "lineitem").select(F.lit("M").alias("kind"), F.lit(None).cast("timestamp").alias("at"), F.concat_ws("-", F.lit("p"), "l_partkey", F.col("l_quantity").cast("int")).alias("h1"), F.lit("ok").alias("status"), F.concat(F.lit("o"), "l_orderkey").alias("h2"), F.concat(F.lit("r"), F.col("l_suppkey")).alias("ref"))
    s = table(spark, sf_dir, "orders").select(F.lit("S").alias("kind"), F.lit(None).cast("timestamp").alias("at"), F.concat(F.lit("o"), "o_orderkey").alias("h1"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("h2"), F.concat(F.lit("c"), "o_custkey").alias("ref"))
    return m.unionByName(s)


def owned_sources(spark, sf_dir):
    return lineage.owned_sources(_ledger(spark, sf_dir))


OWNED_SQL = """
SELECT 'p-' || l_partkey || '-' || CAST(l_quantity AS INTEGER) AS source, 'c' || min(o_custkey) AS job FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT o_custkey) = 1
"""


def clean_plan(spark, sf_dir):
    return lineage.clean_plan(_ledger(spark, sf_dir), "c7").filter("what <> 'report'").select("item", "what", "include", "reason")


CLEAN_SQL = """
WITH r AS (SELECT DISTINCT l_partkey || '-' || CAST(l_quantity AS INTEGER) AS p, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT p, count(*) AS k FROM r GROUP BY p)
SELECT 'p-' || p AS item, 'source' AS what, k = 1 AS include, CASE WHEN k > 1 THEN 'shared source' END AS reason FROM r JOIN n USING (p) WHERE c = 7
UNION ALL SELECT 'o' || o_orderkey, 'stage', true, NULL FROM orders WHERE o_custkey = 7
"""


def newest_orders(spark, sf_dir):
    """The three newest orders of each customer."""
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("place", F.row_number().over(w))
    return rows.filter("place <= 3").select("o_custkey", "o_orderkey", "place")


NEWEST_SQL = "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS place FROM orders QUALIFY place <= 3"


def multiset_difference(spark, sf_dir):
    """Words of even and odd turns that don't occur equally often, counted."""
    rows = turns(spark, sf_dir).select((F.col("seq") % 2).alias("odd"), F.explode(F.split("text", " ")).alias("word"))
    diff = lineage.same_multiset(rows.filter("odd = 0").select("word"), rows.filter("odd = 1").select("word"))
    return diff.groupBy("side", "word").agg(F.count("*").alias("n"))


MULTISET_SQL = """
WITH w AS (SELECT turn % 2 AS odd, unnest(string_split(text, ' ')) AS word FROM conversations),
     c AS (SELECT word, count(*) FILTER (WHERE odd = 0) - count(*) FILTER (WHERE odd = 1) AS d FROM w GROUP BY word)
SELECT CASE WHEN d > 0 THEN 'left' ELSE 'right' END AS side, word, abs(d) AS n FROM c WHERE d <> 0
"""


def near_words(spark, sf_dir):
    """Words of conversations and of benchmark items of 5 to 7 letters that differ in exactly one."""
    shape = F.lit("[a-z]{5,7}")
    words = turns(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", shape, F.lit(0))).alias("word"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", shape, F.lit(0))).alias("surface"))
    return registry.near_names(words, known).select("word", "surface").distinct()


NEAR_SQL = """
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{5,7}')) AS word FROM conversations), b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{5,7}')) AS surface FROM benchmark)
SELECT word, surface FROM w JOIN b ON length(word) = length(surface) AND hamming(word, surface) = 1
"""


def users_of_conversations(spark, sf_dir):
    """Sorted distinct roles of each conversation, joined."""
    return turns(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("role")), "／").alias("users"), F.count("*").alias("n"))


USERS_SQL = "SELECT conv_id AS doc_id, array_to_string(list_sort(list(DISTINCT role)), '／') AS users, count(*) AS n FROM conversations GROUP BY conv_id"


def status_board(spark, sf_dir):
    """Orders by priority with a column for each status."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(f"n_{c.lower()}") for c in "FOP"])


BOARD_SQL = "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{c}') AS n_{c.lower()}" for c in "FOP") + " FROM orders GROUP BY o_orderpriority"


def era_dates(spark, sf_dir):
    """Order dates as era dates, serials and ISO text, and back."""
    d = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"))
    return rows.select("o_orderkey", tx.era_long(F.col("d")).alias("era"), tx.serial(F.col("d")).alias("serial"), (tx.flexible_date(tx.era_long(F.col("d"))) == F.col("d")).alias("back"), tx.weekday(F.col("d")).alias("weekday"))


ERA_SQL = """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, '平成' || (year(d) - 1988) || '年' || month(d) || '月' || day(d) || '日' AS era, CAST(d - DATE '1899-12-30' AS INTEGER) AS serial, true AS back,
       substr('日月火水木金土', dayofweek(d) + 1, 1) AS weekday FROM o
"""


def token_multiset(spark, sf_dir):
    """Word counts of each document with at least 20 of one word."""
    rows = units(spark, sf_dir).select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return rows.groupBy("doc_id", "word").agg(F.count("*").alias("n")).filter("n >= 20")


TOKENS_SQL = "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY ALL HAVING count(*) >= 20"


def interval_join(spark, sf_dir):
    """Events of each user in the 50-wide interval that holds their value, by containment."""
    marks = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.floor("value").cast("long").alias("pos")).distinct()
    holders = marks.select("doc_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19)))).select("doc_id", (F.col("i") * 50).cast("long").alias("start"), (F.col("i") * 50 + 50).cast("long").alias("end"), F.col("i").cast("string").alias("name"))
    return cells.enclosing(marks, holders).select("doc_id", "pos", "name")


INTERVAL_SQL = "SELECT DISTINCT user_id AS doc_id, CAST(floor(value) AS BIGINT) AS pos, CAST(CAST(floor(value) AS BIGINT) // 50 AS VARCHAR) AS name FROM events WHERE floor(value) >= 0 AND floor(value) < 1000"


def new_contents(spark, sf_dir):
    """Documents whose text no document of another source has, by size and hash."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size"), F.sha2("text", 256).alias("hash"))
    return lineage.new_files(rows.filter("source <> 'src0'"), rows.filter("source = 'src0'")).select("doc_id", "hash")


NEW_SQL = "SELECT doc_id, sha256(text) AS hash FROM documents WHERE source <> 'src0' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')"


def pages_of_documents(spark, sf_dir):
    """Lines of the printed pages of each document."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.split("text", "\n").alias("paras"))
    return records.paginated(rows).select("record_id", "page", F.size("paras").alias("n_paras"))


def chunks_of_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.split("text", "\n").alias("paras"))
    return records.chunked(rows).select("record_id", "chunk", "lines", F.size("paras").alias("n_paras"))


def years_of_orders(spark, sf_dir):
    """Years of each customer's orders, inferred from their months and the marked first row."""
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.row_number().over(w).alias("row"), F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("y"))
    rows = rows.select("book", "row", "month", F.when(F.col("row") == 1, F.col("y")).alias("marked_year"))
    return records.inferred_years(rows, 1998, 8).select("book", "row", "month", "year")


YEARS_SQL = """
WITH o AS (SELECT o_custkey AS book, CAST(row_number() OVER w AS INTEGER) AS row, CAST(month(o_orderdate) AS INTEGER) AS month, year(o_orderdate) AS y FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)),
     f AS (SELECT *, CASE WHEN month > lag(month) OVER (PARTITION BY book ORDER BY row) THEN 1 ELSE 0 END AS fall FROM o)
SELECT book, row, month, CAST(first_value(y) OVER w - sum(fall) OVER w AS INTEGER) AS year FROM f WINDOW w AS (PARTITION BY book ORDER BY row)
"""


def segments_of_mails(spark, sf_dir):
    """Segments of documents with a mail: plain text and mails, by number and length."""
    text = F.col("text")
    rows = units(spark, sf_dir).filter(text.contains("@")).select("doc_id", F.posexplode(spans.segments(text, spans.fold(candidates(text, (MAIL,)), text))).alias("pos", "s"))
    return rows.groupBy("doc_id", F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("s.text")).alias("n_chars"))


SEGMENTS_SQL = f"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '{MAIL_RE}') AS v, list_filter(regexp_split_to_array(text, '{MAIL_RE}'), lambda x: x <> '') AS g FROM documents WHERE contains(text, '@'))
SELECT doc_id, 'plain' AS kind, CAST(len(g) AS BIGINT) AS n, CAST(list_sum(list_transform(g, lambda x: length(x))) AS BIGINT) AS n_chars FROM m WHERE len(g) > 0
UNION ALL SELECT doc_id, 'メール', CAST(len(v) AS BIGINT), CAST(list_sum(list_transform(v, lambda x: length(x))) AS BIGINT) FROM m WHERE len(v) > 0
"""


def merged_customers(spark, sf_dir):
    """Customers as a registry: duplicates of kind and first part of the name merged, aliases in order."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("row_no"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").cast("string").alias("name"), F.array(F.col("c_name")).alias("aliases"), F.lit("").alias("reading"))
    return registry.merged(rows).select("kind", "name", "row_no", F.size("aliases").cast("long").alias("n_aliases"), "n_rows")


MERGED_SQL = "SELECT c_mktsegment AS kind, CAST(c_nationkey AS VARCHAR) AS name, CAST(min(c_custkey) AS INTEGER) AS row_no, count(DISTINCT c_name) AS n_aliases, count(*) AS n_rows FROM customer GROUP BY ALL"


def suspects_of_documents(spark, sf_dir):
    """Suspects of all documents by rule."""
    excluded = spark.createDataFrame([], "word string")
    return suspects.find(units(spark, sf_dir), excluded).select("doc_id", "rule", "word", "reason")


def exact_locations(spark, sf_dir):
    """Places of IPv4-like strings that the generic locator finds."""
    rows = units(spark, sf_dir).filter(F.col("text").rlike(r"[0-9]\.[0-9]")).select("doc_id", F.explode(located(F.col("text"), r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")).alias("m"))
    return rows.select("doc_id", F.col("m.st").cast("long").alias("st"), F.col("m.orig").alias("orig"))


QUERIES: dict[str, Query] = {
    "mail_spans": mail_spans, "number_spans": number_spans, "exact_locations": exact_locations, "overlap_fold": overlap_fold, "segments_of_mails": segments_of_mails,
    "mail_codebook": mail_codebook, "mask_restore": mask_restore, "replacement_counts": replacement_counts, "leftover_gate": leftover_gate, "document_status": document_status,
    "flagged_documents": flagged_documents, "suspects_of_documents": suspects_of_documents, "duplicate_texts": duplicate_texts, "nearest_turn": nearest_turn, "previous_turn": previous_turn,
    "valid_orders": valid_orders, "formula_closure": formula_closure, "owned_sources": owned_sources, "clean_plan": clean_plan, "newest_orders": newest_orders,
    "multiset_difference": multiset_difference, "near_words": near_words, "users_of_conversations": users_of_conversations, "status_board": status_board, "era_dates": era_dates,
    "token_multiset": token_multiset, "interval_join": interval_join, "new_contents": new_contents, "merged_customers": merged_customers,
    "pages_of_documents": pages_of_documents, "chunks_of_documents": chunks_of_documents, "years_of_orders": years_of_orders,
}
ORACLE_SQL: dict[str, str] = {
    "mail_spans": _SPANS_SQL.format(r=MAIL_RE), "number_spans": _SPANS_SQL.format(r=NUMBER_RE), "exact_locations": _SPANS_SQL.format(r=r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), "overlap_fold": FOLD_SQL,
    "mail_codebook": CODEBOOK_SQL, "mask_restore": MASK_SQL, "replacement_counts": COUNTS_SQL, "leftover_gate": LEFT_SQL, "document_status": STATUS_SQL,
    "flagged_documents": FLAG_SQL, "segments_of_mails": SEGMENTS_SQL, "duplicate_texts": DUPLICATE_SQL, "nearest_turn": NEAREST_SQL, "previous_turn": PREVIOUS_SQL,
    "valid_orders": VALID_SQL, "formula_closure": CLOSURE_SQL, "owned_sources": OWNED_SQL, "clean_plan": CLEAN_SQL, "newest_orders": NEWEST_SQL,
    "multiset_difference": MULTISET_SQL, "near_words": NEAR_SQL, "users_of_conversations": USERS_SQL, "status_board": BOARD_SQL, "era_dates": ERA_SQL,
    "token_multiset": TOKENS_SQL, "interval_join": INTERVAL_SQL, "new_contents": NEW_SQL, "merged_customers": MERGED_SQL, "years_of_orders": YEARS_SQL,
}
QUERIES |= marked.QUERIES | linked.QUERIES | broken.QUERIES | cases.QUERIES
ORACLE_SQL |= marked.ORACLE_SQL | linked.ORACLE_SQL | broken.ORACLE_SQL | cases.ORACLE_SQL

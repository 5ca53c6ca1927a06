"""Line dedup with a log-template tree.

Lines are parsed down a tree of fixed depth: by their number of tokens, then by their leading tokens,
as many as they have; tokens with a digit are variable from the start, unless a short line has no others. In a leaf that several different lines reach, the
positions at which nearly all of them agree are constant and the others are variable fields; if
enough positions are constant the leaf has a template for the lines that fit it. The lines that don't
are dealt to leaves of their own by their token at the position of fewest different tokens, and tried
again, up to LEVELS times, so a leaf may hold several templates; lines that fit none are templates by
themselves. Lines of templates that recur across documents are dropped, in all documents.

Copies of a document make all its lines recur, and are not what this operator is for. So documents
with equal texts count once, and a template's support is its number of different anchors. A document's
other lines are ordered by how many texts have them, in powers of two; the anchor is the smallest hash
in the power that is reached after a share of SHARED of the lines. So a header or footer of many lines
isn't its own anchor while the document has more lines of its own than that share, and documents that
have fewer are near copies, which share their anchors. Anchors are counted in several hash orders, and
the median counts. A template is dropped if it has `least` anchors and
these are at least `variety` of its documents.

All is DataFrame functions. Tokens of lines are kept as 32-bit hashes. The rows of a hot template or
leaf are dealt over many tasks.

A word without a digit among the leading tokens is taken as constant, so templates that vary there
without one are as many templates.

Defined cases: a null text stays null. Lines without tokens reach no leaf and
stay. A text of dropped lines only becomes empty. Rows that agree in doc_id and text are
rewritten alike. Columns other than text and n_chars are passed on; n_chars, if there, follows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, hot_keys, kept, skewed_join

#: Leading tokens of the tree; anchors that make a template recur; their share of its documents;
#: agreement that makes a position constant; share of constant positions that makes a leaf a template.
DEPTH, LEAST, VARIETY, AGREE, CONSTANT = 3, 5, 0.5, 0.8, 0.5
#: Orders in which anchors are taken; the median of their numbers counts.
ORDERS = 3
#: Times that a leaf's lines are tried for a template, dealt by a further token after each.
LEVELS = 3
#: Share of own lines up to which documents are copies of each other.
SHARED = 0.2
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"


def parsed(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row for each line that reaches a leaf: doc_id, h (of the text), pos, leaf, line, tokens."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    masked = F.when(F.col("raw").rlike("[0-9]"), F.regexp_replace("raw", VARIABLE, "<*>")).otherwise(F.col("raw"))
    trim = F.lit(" \t\r\x0b\x0c")
    lines = lines.withColumn("t", F.split(F.btrim(masked, trim), r"\s+")).filter(F.col("t")[0] != "")
    # A short line of variable tokens only, such as a number, has nothing constant: it stands for itself.
    bare = (F.size("t") < depth) & ~F.exists("t", lambda x: x != "<*>")
    lines = lines.withColumn("t", F.when(bare, F.split(F.btrim("raw", trim), r"\s+")).otherwise(F.col("t")))
    leaf = F.xxhash64(F.size("t"), *[F.get("t", F.lit(i)) for i in range(depth)])
    return lines.select("doc_id", "h", "pos", leaf.alias("leaf"), F.xxhash64("t").alias("line"), F.transform("t", lambda x: F.hash(x)).alias("tokens"))


def generalised(seen: DataFrame, least: int = LEAST, agree: float = AGREE, constant: float = CONSTANT) -> DataFrame:
    """leaf, constants (array of pos, token; null if the leaf is no template) and split (the position by
    which its other lines are dealt) of leaves that at least `least` different lines reach."""
    counts = seen.select("leaf", F.posexplode("tokens").alias("pos", "token")).groupBy("leaf", "pos", "token").agg(F.count("*").alias("n"))
    best = counts.groupBy("leaf", "pos").agg(F.max(F.struct("n", "token")).alias("best"), F.sum("n").alias("all"), F.count("*").alias("different")).filter(F.col("all") >= least)
    steady = F.collect_list(F.when(F.col("best.n") >= agree * F.col("all"), F.struct("pos", F.col("best.token").alias("token"))))
    leaves = best.groupBy("leaf").agg(steady.alias("constants"), F.count("*").alias("width"), F.min(F.when(F.col("different") > 1, F.struct("different", "pos"))).alias("split"))
    is_template = (F.size("constants") >= constant * F.col("width")) & (F.size("constants") < F.col("width"))
    return leaves.select("leaf", F.when(is_template, F.col("constants")).alias("constants"), F.col("split.pos").alias("split"))


def templates(lines: DataFrame, hot: DataFrame, least: int = LEAST, agree: float = AGREE, constant: float = CONSTANT, levels: int = LEVELS) -> DataFrame:
    """line and template of the different lines that fit a template of their leaf. hot: leaves that many
    lines reach."""
    several = lines.select("leaf", "line").distinct().groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("leaf")
    seen = kept(skewed_join(lines.select("leaf", "line", "tokens"), several, ["leaf"], F.col("line"), hot).distinct(), "seen")
    found = []
    for level in range(levels):
        leaves = kept(generalised(seen, least, agree, constant), "leaves")
        met = skewed_join(seen, leaves, ["leaf"], F.col("line"), hot if level == 0 else hot_keys(seen, ["leaf"]))
        fits = F.coalesce(F.forall("constants", lambda c: F.col("tokens")[c["pos"]] == c["token"]), F.lit(False))
        met = kept(met.withColumn("fits", fits), "fitted")
        found.append(met.filter("fits").select("line", F.xxhash64("leaf", F.lit(level)).alias("template")))
        if level + 1 < levels:
            # A token at the split deals the others; without a split all lines are one, and one doesn't come back.
            seen = met.filter("not fits and split is not null").select(F.xxhash64("leaf", F.lit(level), F.col("tokens")[F.col("split")]).alias("leaf"), "line", "tokens")
            seen = kept(seen, "seen")
    return reduce(DataFrame.unionAll, found)


def recurring(lines: DataFrame, least: int = LEAST, variety: float = VARIETY, agree: float = AGREE, constant: float = CONSTANT) -> DataFrame:
    """doc_id, h, pos of the lines whose template recurs."""
    fitted = kept(templates(lines, hot_keys(lines, ["leaf"]), least, agree, constant), "fits")
    fitted = skewed_join(lines.select("doc_id", "h", "pos", "line"), fitted, ["line"], F.struct("h", "pos"), hot_keys(lines, ["line"]), "left")
    found = kept(fitted.select("doc_id", "h", "pos", F.coalesce("template", "line").alias("template")), "templates")
    hot = hot_keys(found, ["template"])
    texts = kept(found.select("h", "template").distinct(), "texts")
    # Templates of one text need no row.
    counts = texts.groupBy("template").agg(F.count("*").alias("texts")).filter("texts > 1")
    counted = skewed_join(texts, counts, ["template"], F.col("h"), hot, "left").withColumn("texts", F.coalesce("texts", F.lit(1)))
    rare = F.floor(F.log2("texts")).cast("int").alias("rare")
    by_text = counted.groupBy("h").agg(F.array_sort(F.collect_list(F.struct(rare, "template", "texts"))).alias("all"))
    # A template's anchor is taken at this place of the others, so at the next one if it stands before it.
    place = F.floor(F.lit(SHARED) * F.size("all")).cast("int")
    classes = F.array(*[F.get("all", place + i)["rare"] for i in range(2)])

    def least_two(k: int) -> Column:
        return F.slice(F.array_sort(F.transform("peers", lambda t: F.struct(F.xxhash64(t, F.lit(k)), t))), 1, 2).cast("array<struct<x:long,template:long>>")

    peers = F.transform(classes, lambda c: F.transform(F.filter("all", lambda t: t["rare"] == c), lambda t: t["template"]))
    often = by_text.filter(F.exists("all", lambda t: t["texts"] >= least)).select("h", place.alias("place"), "all", F.posexplode(peers).alias("side", "peers"))
    often = often.select("place", "side", F.array(*map(least_two, range(ORDERS))).alias("two"), F.posexplode("all").alias("at", "t"))
    often = often.filter((F.col("t.texts") >= least) & (F.col("side") == (F.col("at") <= F.col("place")).cast("int")))
    anchors = F.transform("two", lambda two: F.coalesce(F.get(F.filter(two, lambda x: x["template"] != F.col("t.template")), F.lit(0))["x"], F.lit(0)))
    support = often.select("t.template", "t.texts", F.posexplode(anchors).alias("order", "anchor")).distinct()
    support = support.groupBy("template", "texts", "order").agg(F.count("*").alias("anchors")).groupBy("template", "texts").agg(F.element_at(F.sort_array(F.collect_list("anchors")), (ORDERS + 1) // 2).alias("anchors"))
    dropped = support.filter((F.col("anchors") >= least) & (F.col("anchors") >= variety * F.col("texts"))).select("template")
    return skewed_join(found, dropped, ["template"], F.struct("h", "pos"), hot).select("doc_id", "h", "pos")


def dedup(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, variety: float = VARIETY, agree: float = AGREE, constant: float = CONSTANT) -> DataFrame:
    """docs with the recurring lines gone from text; adds n_lines and n_dropped, in place of columns of
    these names."""
    docs = docs.drop("n_lines", "n_dropped")
    g_id, g_h, own = free_names(docs.columns, "_id", "_h", "_gone")
    lines = kept(parsed(docs.select("doc_id", "text"), depth), "lines")
    gone = recurring(lines, least, variety, agree, constant).groupBy(F.col("doc_id").alias(g_id), F.col("h").alias(g_h)).agg(F.collect_set("pos").alias(own))
    rows = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(g_id)) & (F.xxhash64("text") == F.col(g_h)), "left")
    parts = F.split("text", "\n", -1)
    stay = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(own, i)), "\n")
    rows = rows.withColumn("n_lines", F.coalesce(F.size(parts), F.lit(0))).withColumn("n_dropped", F.coalesce(F.size(own), F.lit(0)))
    rows = rows.withColumn("text", F.when(F.col(own).isNotNull(), stay).otherwise(F.col("text"))).drop(g_id, g_h, own)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows

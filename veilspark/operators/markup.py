"""Masking in raw markup: only text zones change, everything else stays byte for byte.

A lexer cuts markup into tokens that put together are the markup again: comments, declarations, scripts and
styles with all they hold, tags, and texts. Findings are searched in the view of a text token in which
character references are the characters they stand for, and mapped back, so an address that is written
with references is found and replaced whole; attributes, comments and scripts are never touched.

Defined cases: null markup stays null; markup without tags is one text; an unclosed comment or script goes to the
end; a `<` that begins no tag is text. Pages that are equal in key and markup are masked alike. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import views

#: Tokens: comments, declarations, scripts and styles, tags, texts.
TOKEN = r"(?is)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|</?[a-z!?](?:\x22[^\x22]*\x22|'[^']*'|[^'\x22>]+)*+>|[^<]+|<"


def tokens(markup: Column) -> Column:
    """array<string> of the tokens; joined they are the markup."""
    return F.regexp_extract_all(markup, F.lit(TOKEN), F.lit(0))


def zone(token: Column) -> Column:
    low = F.lower(F.substring(token, 1, 9))
    return F.when(low.startswith("<!--"), "comment").when(low.rlike("^<script"), "script").when(low.rlike("^<style"), "style").when(low.rlike("^</?[a-z!?]"), "tag").otherwise("text")


def masked(pages: DataFrame, key: str, markup: str, pattern: str, code: str, guard: str, view: str = views.REFERENCE) -> DataFrame:
    """key, masked markup, found (array of what was replaced, as written, in order) of the pages. Tokens that
    can't hold a finding, which the guard (a pattern over the raw token) tells, are passed by. view: views.STRICT
    if an ampersand that begins no reference isn't to be taken for one."""
    pages = pages.select(key, markup)
    raw = pages.select(key, F.col(markup).alias("raw"), F.xxhash64(markup).alias("h"), F.posexplode_outer(tokens(F.col(markup))).alias("at", "token"))
    able = raw.filter((zone(F.col("token")) == "text") & F.col("token").rlike(guard))
    viewed = views.with_view(able.select(key, "h", "at", F.col("token").alias("text")), view)
    spans = views.mapped(F.col("view"), views.matched(F.col("view"), pattern))
    hits = viewed.withColumn("spans", spans).filter(F.size("spans") > 0)
    pieces = F.transform("spans", lambda s: F.substring(F.col("text"), s["st"] + 1, s["en"] - s["st"]))
    hits = hits.select(key, "h", F.struct("at", views.replaced(F.col("text"), F.col("spans"), lambda _: F.lit(code)).alias("new"), pieces.alias("found")).alias("hit"))
    changed = hits.groupBy(F.col(key).alias("_key"), F.col("h").alias("_h")).agg(F.sort_array(F.collect_set("hit")).alias("hits"))
    rows = pages.join(changed, F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(markup) == F.col("_h")), "left")
    # A token that was replaced is put in its place; pages without one aren't cut at all.
    put = F.array_join(F.transform(tokens(F.col(markup)), lambda t, i: F.coalesce(F.try_element_at(F.filter("hits", lambda x: x["at"] == i), F.lit(1))["new"], t)), "")
    none = F.array().cast("array<string>")
    return rows.select(key, F.when(F.col("hits").isNotNull(), put).otherwise(F.col(markup)).alias("masked"), F.coalesce(F.flatten(F.transform("hits", lambda x: x["found"])), none).alias("found"))


def restored(markup: Column, code: str, found: Column) -> Column:
    """The markup with the codes replaced, in order, by what was found."""
    parts = F.split(markup, F.regexp_replace(F.lit(code), r"([\[\]{}()*+?.\\^$|])", r"\\$1"), -1)
    return F.concat(F.element_at(parts, 1), F.array_join(F.zip_with(found, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda f, p: F.concat(F.coalesce(f, F.lit(code)), F.coalesce(p, F.lit("")))), ""))

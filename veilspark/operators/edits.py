"""Changes to the registry as relations: what is added, changed, removed or refused, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import bad_name
from ..functions.text import norm_name
from ..storage import ranked_within
from .registry import EXCLUDED, dictionary


def added(registry: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry with the accepted rows of new, refused rows with the reason). new: kind, name, aliases,
    reading. A row that exists already, or twice in new, is refused but for its first."""
    keyed = new.withColumn("norm", norm_name(F.col("name"))).withColumn("reason", bad_name(F.col("name")))
    known = registry.select("kind", norm_name(F.col("name")).alias("norm")).distinct().withColumn("known", F.lit(True))
    first = keyed.groupBy("kind", "norm").agg(F.min(F.struct("name", "aliases", "reading", "reason")).alias("r"), F.count("*").alias("n"))
    judged = first.join(known, ["kind", "norm"], "left").select("kind", "norm", "r.*", "n", F.coalesce("known", F.lit(False)).alias("known"))
    why = F.coalesce("reason", F.when(F.col("known"), "exists"))
    good = judged.filter(why.isNull())
    last = registry.agg(F.coalesce(F.max("row_no"), F.lit(0))).first()[0]
    placed = ranked_within(good.withColumn("all", F.lit(0)), "all", ["kind", "norm"], "place")
    rows = placed.select((F.col("place") + last).cast("int").alias("row_no"), "kind", "name", "aliases", "reading")
    refused = judged.filter(why.isNotNull()).select("kind", "name", why.alias("reason")).unionByName(judged.filter("n > 1").select("kind", "name", F.lit("given twice").alias("reason")))
    return registry.unionByName(rows), refused


def changed(registry: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry after edits, edits whose row isn't any more as it was seen). edits: row_no, old_kind,
    old_name, kind, name, aliases, reading; a null kind deletes the row."""
    seen = registry.select("row_no", F.col("kind").alias("is_kind"), F.col("name").alias("is_name"))
    met = edits.join(seen, "row_no", "left").withColumn("current", F.coalesce((F.col("is_kind") == F.col("old_kind")) & (F.col("is_name") == F.col("old_name")), F.lit(False)))
    good = met.filter("current").select("row_no", "kind", "name", "aliases", "reading")
    return registry.join(good.select("row_no"), "row_no", "left_anti").unionByName(good.filter("kind is not null")), met.filter("not current").select("row_no", "old_kind", "old_name")


def excludable(words: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words to exclude, words refused because somebody registered is called so): excluding never
    unmasks a registered word."""
    own = dictionary(registry).select(norm_name(F.col("surface")).alias("norm")).distinct()
    asked = words.select(F.trim("word").alias("word"), norm_name(F.col("word")).alias("norm")).filter("norm <> ''").dropDuplicates(["norm"])
    there = registry.filter(F.col("kind") == EXCLUDED).select(norm_name(F.col("name")).alias("norm"))
    return asked.join(own, "norm", "left_anti").join(there, "norm", "left_anti").select("word"), asked.join(own, "norm", "left_semi").select("word")


def alias_collisions(new: DataFrame, book: DataFrame) -> DataFrame:
    """New aliases (person, alias) whose key the codebook has already for somebody else."""
    used = book.filter(F.col("key").startswith("別|")).select(F.element_at(F.split("key", r"\|"), -1).alias("alias"), "code").distinct()
    return new.join(used, "alias")


def address_aliases(aliases: DataFrame) -> DataFrame:
    """Alias lists of address rows (row_no, aliases) split into addresses: an alias without a lot number
    is a building and goes to the address before it."""
    from ..functions.address import has_lot

    rows = aliases.select("row_no", F.posexplode("aliases").alias("pos", "alias")).withColumn("head", has_lot(F.col("alias")))
    by = rows.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("pos", "head", "alias"))).alias("all"))

    def step(acc, a):
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit("　"), a["alias"])))
        return F.when(a["head"] | (F.size(acc) == 0), F.concat(acc, F.array(a["alias"]))).otherwise(joined)

    return by.select("row_no", F.explode(F.aggregate("all", F.array().cast("array<string>"), step)).alias("address"))

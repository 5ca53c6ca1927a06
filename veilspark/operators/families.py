"""Families: rows that share a key with each other, directly or over others.

Every row hangs on another (at first on itself). In a round a key hands the least row that its rows hang
on to all of them and to what they hang on, and hanging is shortened by one step. A key is a minimum over
its rows, never pairs of them, so a key that a third of the rows share costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import hot_keys, kept, shuffled, skewed_join, spread_join


def _over(hung: DataFrame) -> DataFrame:
    """hung (id, up) with `top`, what `up` hangs on. Only rows that others hang on are looked up, which soon are few."""
    tops = hung.join(shuffled(hung.filter("up <> id").select(F.col("up").alias("id")).distinct()), "id", "left_semi")
    tops = kept(tops.select(F.col("id").alias("up"), F.col("up").alias("top")), "tops")
    found = spread_join(hung.filter("up <> id"), tops, ["up"], F.col("id"))
    return found.select("id", "up", "top").unionByName(hung.filter("up = id").withColumn("top", F.col("up")))


def families(rows: DataFrame, id_: str, keys: str) -> DataFrame:
    """id and family (the least id that it reaches over shared keys, itself included), one row for each id.
    keys: a column of arrays. Null ids are left out; null keys, empty and null arrays share nothing."""
    ids = rows.select(F.col(id_).alias("id"), F.col(keys).alias("keys")).filter("id IS NOT NULL")
    members = kept(ids.select("id", F.explode("keys").alias("key")).filter("key IS NOT NULL").distinct(), "members")
    hot = hot_keys(members, ["key"])
    hung = kept(ids.select("id").distinct().withColumn("up", F.col("id")), "hung")
    while True:
        above = kept(_over(hung), "above")
        met = kept(members.join(shuffled(above), "id"), "met")
        least = kept(met.groupBy("key").agg(F.min("top").alias("least")), "least")
        told = skewed_join(met.select("key", "id", "up"), least, ["key"], F.col("id"), hot, wide=True)
        news = told.select("id", "least").unionByName(told.select(F.col("up").alias("id"), "least")).unionByName(above.select("id", F.col("top").alias("least")))
        next_ = kept(news.groupBy("id").agg(F.min("least").alias("up")), "hung")
        # What a row hangs on only gets less, so the loop ends.
        changed = next_.join(shuffled(hung), ["id", "up"], "left_anti").limit(1).count()
        hung = next_
        if not changed:
            return hung.select("id", F.col("up").alias("family"))

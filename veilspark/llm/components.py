"""Connected components of a graph in tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import BROADCAST_ROWS, ROWS_OF_A_TASK
from .common import hot_keys, kept, salted_join, skewed_join, spread_join


#: Edges up to which a round is one task without a shuffle, as it is of a few hundred kB; more are joined over shuffles.
EDGES_OF_A_TASK = BROADCAST_ROWS // 2


def _around(edges: DataFrame, large: bool) -> DataFrame:
    if not large:
        return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Link each node's larger (or other) neighbours to the smallest node around it. rows: about how many edges
    there are; few stay in one task, and neither a shuffle nor a broadcast is made for them."""
    few = rows <= EDGES_OF_A_TASK
    around = _around(edges.coalesce(1) if few else edges, large)
    if few:
        met = around.withColumn("least", F.least("a", F.min("b").over(W.partitionBy("a"))))
    else:
        least = around.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        met = salted_join(around, least, ["a"], F.col("b"), salts=8)
    tasks = -(-rows // ROWS_OF_A_TASK) or 1
    if large:
        found = met.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    elif few:
        ends = F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))
        found = met.select(F.explode(ends).alias("e")).select("e.*").filter("a <> b")
    else:
        own = least.filter("a <> least").select("a", F.col("least").alias("b"))
        found = met.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(own)
    return found.distinct() if few else found.distinct().coalesce(tasks)


def _measured(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether each node has one edge (a, b) at most and no b has any: all edges
    lead to roots."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.out").alias("out"), F.max("e.into").alias("into"))
    rows, open_ = nodes.agg(F.coalesce(F.sum("out"), F.lit(0)), F.count_if(F.expr("out > 1 or out = 1 and into = 1"))).first()
    return rows, not open_


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root, the smallest node that it reaches, for the nodes of edges (a, b) that aren't roots. Each
    round is written to the shared folder; only its count reaches the driver."""
    edges = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    rows, settled = _measured(edges)
    for _ in range(rounds):
        if settled:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = kept(_star(_star(edges, True, rows), False, rows), "stars")
        rows, settled = _measured(edges.coalesce(1) if rows <= EDGES_OF_A_TASK else edges)
    raise RuntimeError(f"no end after {rounds} rounds")


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots, as `components` returns them, after further links (a, b). Only what these unite is crossed again: links between
    roots, and not those that made the roots."""
    for end, other in (("a", "b"), ("b", "a")):
        named = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        links = kept(skewed_join(links, named, [end], F.col(other), hot_keys(links, [end]), "left").select(F.coalesce("_root", end).alias(end), other), "ends")
    more = kept(components(links), "more")
    moved = spread_join(roots, more.select(F.col("node").alias("root"), F.col("root").alias("_root")), ["root"], F.col("node"), "left")
    return moved.select("node", F.coalesce("_root", "root").alias("root")).unionByName(more)

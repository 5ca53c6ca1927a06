"""Exact top-k search by inner product with MaxScore, in shards.

A vector is a document whose terms are its dimensions. In a shard of candidates each dimension has a
posting list with its least and largest value, which bound what a query's term can add. For each
query the terms are ordered by that bound; with the threshold of the k-th best
score so far, the terms whose bounds together don't pass it are non-essential: a candidate to which
no other term adds can't enter. The essential postings of a block of candidates are traversed, and
the other terms are probed, largest bound first, only for candidates that can still pass the
threshold. The best k of all shards are merged.

Queries and candidates meet in cells of a shard and a block of queries, so a task's memory is
bounded; the only rows that meet are a stated query set and all candidates, in blocks.

Defined cases: vectors that are null or hold a null or a non-finite component take no part, nor do rows
without vec_id. A shorter vector counts as padded with zeros, an empty one too. Ties go to the smaller
vec_id. Rows with the query's vec_id are no candidates; other rows that share a vec_id are candidates
each. Each query row has its own k, also among rows that share a vec_id. Fewer than k candidates are
all returned. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, SCALE = 20, 64
#: Candidates of a shard and queries of a block, about; candidates of a block within a shard.
SHARD, QUERIES, BLOCK = 16_384, 4096, 2048
#: Candidates of a shard's first block, which gives the first thresholds.
FIRST = 128
#: Terms that are probed between two looks at the threshold.
PROBES = 4


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and the integer components; floats are widened before they are scaled."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def max_score(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, candidate id, score) of the k best candidates of each query, and the number of postings
    that were touched. ids ascend."""
    limit = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    kind = np.float64 if limit < 2**52 else np.int64  # floats hold these sums exactly
    queries, postings = queries.astype(kind), np.ascontiguousarray(candidates.T).astype(kind)
    n, width = queries.shape
    most = np.maximum(queries * postings.min(axis=1), queries * postings.max(axis=1))
    order = np.argsort(-most, axis=1, kind="stable")
    ordered = np.take_along_axis(most, order, axis=1)
    # What the terms from a position on can add at most, for all candidates and for those without a posting before it.
    none = np.zeros((n, 1), dtype=kind)
    rest = np.concatenate([np.cumsum(ordered[:, ::-1], axis=1)[:, ::-1], none], axis=1)
    alone = np.concatenate([np.cumsum(np.maximum(ordered, 0)[:, ::-1], axis=1)[:, ::-1], none], axis=1)
    rows, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
    threshold, touched = np.full(n, -np.inf), 0
    starts = [0, *range(min(FIRST, len(ids)), len(ids), BLOCK)] if len(ids) else []
    for at, end in zip(starts, [*starts[1:], len(ids)], strict=True):
        block = postings[:, at:end]
        # Essential: terms before the first position from which the rest alone can't pass the threshold.
        essential = (alone[:, :width] > threshold[:, None]).sum(axis=1)
        part = np.zeros((n, end - at), dtype=kind)
        few = essential <= width // 2
        for i in np.flatnonzero(few & (essential > 0)):
            terms = order[i, : essential[i]]
            part[i] = queries[i, terms] @ block[terms]
        many = np.flatnonzero(~few)
        weights = np.zeros((len(many), width), dtype=kind)
        np.put_along_axis(weights, order[many], np.where(np.arange(width) < essential[many, None], np.take_along_axis(queries[many], order[many], axis=1), 0), axis=1)
        part[many] = weights @ block
        touched += int(essential.sum()) * (end - at)
        row, column = np.nonzero(part + rest[np.arange(n), essential][:, None] > threshold[:, None])
        other = ids[at + column] != query_ids[row]
        row, column = row[other], column[other]
        part = part[row, column]
        for i in range(int(essential.min(initial=width)), width):
            probed = essential[row] <= i
            touched += int(probed.sum())
            term = order[row[probed], i]
            part[probed] += queries[row[probed], term] * block[term, column[probed]]
            if i % PROBES == 0:
                able = part + rest[row, np.maximum(i + 1, essential[row])] > threshold[row]
                row, column, part = row[able], column[able], part[able]
        rows, found, score = np.concatenate([rows, row]), np.concatenate([found, ids[at + column]]), np.concatenate([score, part])
        best = np.lexsort((found, -score, rows))
        rows, found, score = rows[best], found[best], score[best]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, found, score = rows[place < k], found[place < k], score[place < k]
        full = np.flatnonzero(np.bincount(rows, minlength=n) == k)
        threshold[full] = score[np.searchsorted(rows, full, side="right") - 1]
    return rows, found, score.astype(np.int64), touched


def search(vectors: DataFrame, is_query: Column, k: int = K, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows where is_query (over vec_id) holds."""
    rows = usable(vectors, vector)
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_queries // QUERIES))

    def dealt(df: DataFrame, parts: int, name: str) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))

    def repeated(df: DataFrame, parts: int, name: str) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    candidates = repeated(dealt(rows, shards, "shard"), blocks, "block")
    # Equal query rows are asked once.
    asked = rows.filter(is_query).groupBy("vec_id", "v").agg(F.count("*").alias("times")).withColumn("row", F.xxhash64("vec_id", "v"))
    queries = repeated(dealt(asked, blocks, "block"), shards, "shard")

    def cell(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({name: [] for name in columns}, dtype="int64")
        held = held.sort_values("vec_id", kind="stable")
        width = max(1, asked["v"].map(len).max(), held["v"].map(len).max())
        ids = asked["vec_id"].to_numpy()
        row, found, score, _ = max_score(matrix(asked["v"], width), ids, matrix(held["v"], width), held["vec_id"].to_numpy(), k)
        return pd.DataFrame(dict(zip(columns, (ids[row], asked["row"].to_numpy()[row], asked["times"].to_numpy()[row], found, score), strict=True)))

    columns = ("query_id", "row", "times", "vec_id", "score")
    best = queries.groupBy("shard", "block").cogroup(candidates.groupBy("shard", "block")).applyInPandas(cell, ", ".join(f"{c} long" for c in columns))
    rank = F.row_number().over(W.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    top = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("query_id", "rank", "vec_id", "score")

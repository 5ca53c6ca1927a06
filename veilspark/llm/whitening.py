"""Whitening of vectors by an exact integer scatter.

Entries become integers, floor(SCALE * c). The covariance is that of the fit list, each different vector
once. A task subtracts a shift (one of the vectors) and accumulates sums and cross-products of the rest
without rounding: float products where they can't leave 53 bits, else of pieces of PIECE bits, summed as
Python's integers. The tasks' sums are cut into limbs of 32 bits, which Spark adds up. n XᵀX - SSᵀ, which no
shift changes, is formed exactly, and only then divided by n² and decomposed. What reaches the driver
are (width + 1)² / 2 sums, whatever the number of rows; a task holds as many and a block of BLOCK vectors.

Defined cases: rows whose vector is null or holds a null or a non-finite entry are dropped, rows without
vec_id stay, rows that repeat are each returned. A shorter vector counts as padded with zeros. Entries
beyond 64 bits saturate. Components are numbered by falling eigenvalue and have their largest entry
(the first, if several) positive; vectors of fewer entries have fewer components. A component without
variance (one vector only, or dependent dimensions) has a null `whitened` and no part in identity_error,
which is null if there is none; `explained` is null if nothing varies. A deviation of more than 38 digits
is an error. An empty table, or one of empty vectors only, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

SCALE, COMPONENTS = 256, 4
#: Vectors of a block, and bits of a piece: BLOCK products of two pieces stay within 53 bits.
BLOCK, PIECE = 4096, 21
LIMB = 32


class Fit(NamedTuple):
    """n vectors with their sums; the components (columns) with their eigenvalues; each eigenvalue's share."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: list[float | None]


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, the integer entries; floats are widened before they are scaled."""
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.filter(F.col(vector).isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long"), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x"))


def padded(x: DataFrame, width: int) -> DataFrame:
    """x with zeros up to the width."""
    return x.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def less(x: np.ndarray, y: list[int]) -> np.ndarray:
    """x - y without overflow."""
    if len(x) and max(-int(x.min()), int(x.max()), *map(abs, y)) >= 1 << 61:
        return x.astype(object) - np.array(y, dtype=object)
    return x - np.array(y, dtype=np.int64)


def squared(a: np.ndarray) -> np.ndarray:
    """aᵀa exactly, of at most BLOCK rows of integers."""
    most = max(-int(a.min()), int(a.max()))
    if len(a) * most * most < 1 << 53:
        f = a.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    half, pieces = 1 << (PIECE - 1), []
    while a.any():
        low = ((a + half) & (2 * half - 1)) - half
        pieces.append(low.astype(np.float64))
        a = (a - low) >> PIECE
    out = np.zeros((a.shape[1], a.shape[1]), dtype=object)
    for i, p in enumerate(pieces):
        for j, q in enumerate(pieces):
            out += (p.T @ q).astype(np.int64).astype(object) << (PIECE * (i + j))
    return out


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """The limbs other than zero, with their places; only the last is signed."""
    place = 0
    while value:
        last = -(1 << 62) <= value < 1 << 62
        limb = value if last else value & ((1 << LIMB) - 1)
        if limb:
            yield place, limb
        value, place = 0 if last else value >> LIMB, place + 1


def scatter(fitted: DataFrame, width: int, shift: list[int]) -> list[list[int]]:
    """Sums of products of all pairs of (entries less the shift, 1) over the vectors x, exactly."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = less(matrix(batch.column(0).slice(at, BLOCK), width), shift)
                total += squared(np.concatenate([part, np.ones((len(part), 1), dtype=part.dtype)], axis=1))
        rows = [(i, j, *limb) for i in range(width + 1) for j in range(i, width + 1) for limb in limbs(int(total[i, j]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "place", "limb"])

    sums = fitted.select("x").mapInArrow(batches_of, "i int, j int, place int, limb long").groupBy("i", "j", "place").agg(F.sum(F.col("limb").cast("decimal(38,0)")).alias("limb"))
    out = [[0] * (width + 1) for _ in range(width + 1)]
    for i, j, place, limb in sums.collect():
        out[i][j] += int(limb) << (LIMB * place)
    for i in range(width + 1):
        for j in range(i):
            out[i][j] = out[j][i]
    return out


def decomposed(products: list[list[int]], shift: list[int], components: int = COMPONENTS) -> Fit:
    """The fit from the exact sums of products."""
    width, n = len(shift), products[-1][-1]
    sums = products[-1][:-1]
    # n XᵀX - SSᵀ; dividing two integers rounds once.
    covariance = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(width)] for i in range(width)], dtype=np.float64).reshape(width, width)
    trace = sum(n * products[i][i] - sums[i] * sums[i] for i in range(width)) / (n * n)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    if width:
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    values = np.where(values > values.max(initial=0) * width * 2**-50, values, 0.0)
    return Fit(n, [s + n * c for s, c in zip(sums, shift, strict=True)], axes, values, [float(v) / trace if trace else None for v in values])


def fit(x: DataFrame, components: int = COMPONENTS) -> tuple[Fit, DataFrame] | None:
    """The fit and its table of the different vectors; x has them with repeats, all of one width."""
    fitted = kept(x.select("x").distinct(), "vectors")
    shift = fitted.agg(F.min("x")).first()[0]
    if shift is None:
        return None
    return decomposed(scatter(fitted, len(shift), shift), shift, components), fitted


def centred(x: np.ndarray, found: Fit) -> np.ndarray:
    """n x - S, exactly."""
    most = max(-int(x.min(initial=0)), int(x.max(initial=0))) * found.n + max(map(abs, found.sums), default=0)
    return less(x * np.int64(found.n) if most < 1 << 62 else x.astype(object) * found.n, found.sums)


def whitened(x: np.ndarray, found: Fit) -> tuple[np.ndarray, np.ndarray]:
    """n x - S and its projections over the roots of the eigenvalues; NaN where there is no variance."""
    away = centred(x, found)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(found.values > 0, 1 / np.sqrt(found.values), np.nan)
    return away, (away / found.n).astype(np.float64) @ found.axes * scale


def projected(rows: DataFrame, found: Fit) -> DataFrame:
    """The rows' first column (vec_id) with deviation and w, the whitened entries (null without variance)."""
    width = len(found.sums)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                away, w = whitened(matrix(part.column("x"), width), found)
                most = max(-int(away.min()), int(away.max()))
                exact = away if width * most * most < 1 << 63 else away.astype(object)
                deviation = pa.array([int(v) for v in (exact * exact).sum(axis=1)], pa.decimal128(38, 0))
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                ends = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), deviation, pa.ListArray.from_arrays(ends, flat)], names=["vec_id", "deviation", "w"])

    return rows.select("vec_id", "x").mapInArrow(batches_of, "vec_id long, deviation decimal(38,0), w array<double>")


def identity_error(fitted: DataFrame, found: Fit) -> float | None:
    """The largest entry of the whitened fit list's covariance, less the identity."""
    live = [k for k, v in enumerate(found.values) if v > 0]
    if not live:
        return None
    w = projected(fitted.select(F.lit(None).cast("long").alias("vec_id"), "x"), found).select(*[F.col("w")[k].alias(f"w{k}") for k in live])
    w = kept(w, "whitened")
    means = w.agg(*[F.avg(f"w{k}") for k in live]).first()
    away = {k: F.col(f"w{k}") - F.lit(m) for k, m in zip(live, means, strict=True)}
    pairs = [(i, j) for i in live for j in live if i <= j]
    entries = w.agg(*[F.avg(away[i] * away[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(entries, pairs, strict=True))


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """A row for each remaining row of vectors and component."""
    rows = usable(vectors, vector)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = padded(rows, width)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, eigenvalue double, explained double, identity_error double"
    fitting = fit(rows, components) if width else None
    if fitting is None:
        return vectors.sparkSession.createDataFrame([], schema)
    found, fitted = fitting
    error = identity_error(fitted, found)
    by_component = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.col("w")[k].alias("whitened"), F.lit(float(v)).alias("eigenvalue"), F.lit(s).cast("double").alias("explained")) for k, (v, s) in enumerate(zip(found.values, found.explained, strict=True))])
    return projected(rows, found).select("vec_id", "deviation", F.explode(by_component).alias("c")).select("vec_id", "c.component", F.lit(found.n).cast("long").alias("n"), "deviation", "c.whitened", "c.eigenvalue", "c.explained", F.lit(error).cast("double").alias("identity_error"))

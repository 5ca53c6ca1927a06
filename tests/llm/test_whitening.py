"""Whitening against Python's integers and fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import whitening

VECTORS = "vec_id long, embedding array<float>, x string, n int, component string"


def table(spark, vectors, schema=VECTORS):
    return spark.createDataFrame([(i, v and [c if c is None else float(c) for c in v], "clash", 0, "c") for i, v in enumerate(vectors)], schema)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute(vectors):
    """{vec_id: (n, deviation, x)}, eigenvalues, axes and trace, in exact integers up to the covariance."""
    width = max((len(v) for v in vectors if usable(v)), default=0)
    xs = {i: tuple(math.floor(256 * float(np.float32(c))) for c in v) + (0,) * (width - len(v)) for i, v in enumerate(vectors) if usable(v)}
    fit = set(xs.values())
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3) for j in range(width)] for i in range(width)]
    values, axes = np.linalg.eigh(np.array(cov, dtype=float))
    return {i: (n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), [float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)]) for i, x in xs.items()}, values[::-1], axes[:, ::-1], float(sum(cov[i][i] for i in range(width)))


def hold(spark, vectors):
    rows, values, axes, trace = brute(vectors)
    got = whitening.whiten(table(spark, vectors)).collect()
    components = min(4, len(values))
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, k + 1) for i in rows for k in range(components))
    signs = {}
    for r in got:
        n, deviation, away = rows[r["vec_id"]]
        k = r["component"] - 1
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        want = float(np.dot(away, axes[:, k]) / math.sqrt(values[k]))
        if abs(want) > 1e-6:
            signs.setdefault(k, r["whitened"] * want > 0)
        assert r["whitened"] == pytest.approx(want if signs.get(k, True) else -want, rel=1e-6, abs=1e-6)
        assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-9)
        assert r["identity_error"] < 1e-4


def test_whitening_of_random_vectors(spark):
    rng = random.Random(1)
    vectors = [[rng.gauss(0.1 * k, 0.1 + 0.2 * k) for k in range(6)] for _ in range(300)]
    odd = [vectors[0]] * 200 + [vectors[1], None, [None] * 6, [math.nan] * 6, [math.inf, 0, 0, 0, 0, 0], [0.5, -0.5], [], [-0.0] * 6]
    hold(spark, vectors + odd)


@pytest.mark.parametrize("scale, offset", [(1.0, 3e6), (1e9, 0.0), (8e12, 6e12)])
def test_sums_beyond_floats_and_longs(spark, scale, offset):
    """Large offsets leave no digits to floats; products of large values need more than 64 bits."""
    rng = random.Random(2)
    hold(spark, [[offset + rng.gauss(0, 1) * scale * (k + 1) for k in range(3)] for _ in range(200)])


def test_scatter_is_exact(spark):
    rng = random.Random(3)
    for size in (1 << 8, 1 << 40, (1 << 63) - 1):
        xs = [[rng.randrange(-size, size) for _ in range(4)] for _ in range(150)]
        shift = xs[0]
        got = whitening.scatter(spark.createDataFrame([(x,) for x in xs], "x array<long>"), 4, shift)
        rest = [[c - s for c, s in zip(x, shift, strict=True)] + [1] for x in xs]
        assert got == [[sum(r[i] * r[j] for r in rest) for j in range(5)] for i in range(5)]


def test_limbs_add_up():
    rng = random.Random(4)
    for v in [0, 1, -1, 1 << 62, -(1 << 62) - 1, *(rng.randrange(-(1 << 300), 1 << 300) for _ in range(50))]:
        assert sum(limb << (32 * place) for place, limb in whitening.limbs(v)) == v


def test_components_without_variance(spark):
    line = whitening.whiten(table(spark, [[float(i), 2.0 * i, 7.0] for i in range(9)])).collect()
    assert len(line) == 27 and all((r["whitened"] is None) == (r["component"] > 1) for r in line) and line[0]["identity_error"] < 1e-9
    one = whitening.whiten(table(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(one) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in one)


def test_empty_tables_and_rows_without_ids(spark):
    assert whitening.whiten(table(spark, [])).collect() == [] and whitening.whiten(table(spark, [[], None])).collect() == []
    rows = table(spark, [[0.1 * i, 0.3 * (i % 3)] for i in range(10)]).withColumn("vec_id", F.when(F.col("vec_id") > 4, F.col("vec_id")))
    assert whitening.whiten(rows).filter("vec_id is null").count() == 10

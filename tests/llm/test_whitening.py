"""Whitening against a dense decomposition, ranks below the dimension, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import whitening


def dense(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - s) ** 2).sum(1), c, e[::-1], v[:, ::-1].T


def check(rows, ids, vectors, components=32):
    n, deviation, c, e, v = dense(vectors)
    rank = min(components, int((e > 1e-12 * e[0]).sum())) if e[0] > 0 else 0
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(by) == len(ids) * rank
    for k in range(rank):
        got = np.array([by[i, k + 1]["whitened"] for i in ids])
        want = c @ v[k] / np.sqrt(e[k])
        assert np.allclose(got * np.sign(got @ want), want, atol=1e-8)
        assert by[ids[0], k + 1]["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-10)
    for i, d in zip(ids, deviation):
        for k in range(rank):
            r = by[i, k + 1]
            assert (r["n"], r["deviation"]) == (n, d) and r["identity_error"] < 1e-9


def test_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    src = df.collect()
    check(whitening.digest(df).collect(), [r.vec_id for r in src], [r.embedding for r in src])


@pytest.mark.parametrize("kind", ["rank", "equal", "few"])
def test_degenerate_spectra(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "rank":  # three directions among eight dimensions
        x = rng.integers(-9, 9, (50, 3)) @ rng.integers(-4, 4, (3, 8)) / 64
    elif kind == "equal":  # eigenvalues that coincide: any basis of their space would do
        x = np.concatenate([np.eye(6), -np.eye(6)])
    else:
        x = rng.standard_normal((4, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    rows = whitening.digest(df).collect()
    if kind != "equal":
        return check(rows, list(range(len(x))), x)
    assert len(rows) == 12 * 6 and all(r.identity_error < 1e-10 and r.explained == pytest.approx(1 / 6) for r in rows)


def test_steps_and_factor(spark, sf):
    """X V = U B: the small matrix has the singular values of the rows; fewer steps give the first components nearly."""
    rows = whitening.prepared(spark.read.parquet(f"{sf}/embeddings.parquet"))
    x = np.array([r.x for r in rows.collect()])
    c = (len(x) * x - x.sum(0)) / len(x)
    right, b = whitening.bidiagonalise(rows, len(x), x.sum(0))
    assert np.abs(right.T @ right - np.eye(64)).max() < 1e-13
    assert np.array_equal(b, np.triu(b) - np.triu(b, 2))
    u = c @ right @ np.linalg.inv(b)
    assert np.abs(u.T @ u - np.eye(64)).max() < 1e-10
    want = np.linalg.svd(c, compute_uv=False)
    assert np.allclose(np.linalg.svd(b, compute_uv=False), want, rtol=1e-12)
    short = whitening.fit(rows, 2, steps=40)
    assert np.allclose(np.sqrt(short.variances * len(x)), want[:2], rtol=1e-3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [0.5, -0.25, 1.0]), (1, [0.1, 0.2, 0.3]), (1, [0.1, 0.2, 0.3]), (2, [-3.0, 2.0, 0.0]), (None, [1.0, 1.0, -1.0])]
    bad = [(3, None), (4, []), (5, [nan, 1.0, 1.0]), (6, [None, 1.0, 1.0]), (7, [inf, 0.0, 0.0]), (8, [1.0, 2.0])]
    rows = [(*r, "x", "y", "z") for r in good + bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, x string, n string").repartition(3)
    out = whitening.digest(df).collect()
    n, deviation, c, e, v = dense(np.array([r[1] for r in good], np.float32))
    assert sorted((str(r.vec_id), r.component) for r in out) == sorted((str(i), k + 1) for i, _ in good for k in range(3))
    assert {(r.vec_id, r.deviation) for r in out} == {(i, d) for (i, _), d in zip(good, deviation)}
    assert all(r.n == 5 and r.identity_error < 1e-9 for r in out)
    assert whitening.digest(df.where("false")).count() == 0
    assert whitening.digest(df.where("vec_id = 1")).count() == 0  # no variance, no component
    assert whitening.digest(df.where("vec_id = 1")).columns == whitening.digest(df.where("false")).columns


def test_exact_deviation(spark):
    """Sums of squares beyond 2^53 stay exact."""
    x = [[float(i * i % 977) * 1e5, float(i)] for i in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in x]
    sums = [sum(c) for c in zip(*whole)]
    want = {i: sum((500 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(whole)}
    got = {r.vec_id: r.deviation for r in whitening.digest(df).where(F.col("component") == 1).collect()}
    assert got == {i: d if d < 1 << 63 else None for i, d in want.items()} and max(want.values()) > 1 << 62

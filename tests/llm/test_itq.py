"""Embedding groups against all pairs; recall of the index."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_simhash import union

from tapeworks.llm import itq


def brute(rows, threshold=0.9):
    """(id, links, component, kept) of (id, vector) rows."""
    good = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            x /= np.abs(x).max()
            good[k] = x / np.linalg.norm(x)
    pairs = [(a, b) for a in good for b in good if b < a and good[a] @ good[b] >= threshold]
    root = union(len(rows), pairs)
    links, least = np.zeros(len(rows), int), {}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, int(n), least.get(r), i is not None and i == least.get(r)) for (i, _), n, r in zip(rows, links, root)]


def got(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert got(itq.groups(df)) == sorted(brute([(r.vec_id, r.embedding) for r in df.collect()]), key=str)


@pytest.fixture(scope="module")
def clusters():
    """Clusters with cosines from 0.85 to 1, copies, and scaled copies."""
    rng, rows = np.random.default_rng(4), []
    for c in range(60):
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        for _ in range(int(rng.integers(1, 12))):
            noise = rng.standard_normal(64)
            noise /= np.linalg.norm(noise)
            v = centre + noise * rng.uniform(0, 0.35)
            rows += [(len(rows) + k, (v * s).tolist()) for k, s in enumerate([1.0, 1.0, 3.0][: int(rng.integers(1, 4))])]
    return rows


@pytest.mark.parametrize("cell_rows", [3, 2048])
def test_recall(spark, clusters, cell_rows):
    df = spark.createDataFrame(clusters, "vec_id long, embedding array<double>").repartition(4)
    want, have = brute(clusters), got(itq.groups(df, cell_rows=cell_rows))
    by_id = {r[0]: r for r in have}
    assert all(by_id[w[0]][1] <= w[1] for w in want)  # no link below the threshold
    recall = sum(by_id[w[0]][1] for w in want) / sum(w[1] for w in want)
    assert recall >= 0.97
    assert sum(by_id[w[0]][2] == w[2] for w in want) >= 0.97 * len(want)


def test_odd_rows(spark):
    e = [0.0] * 62
    rows = [
        (5, [1.0, 0.0, *e]), (3, [1.0, 0.0, *e]), (4, [2.0, 0.001, *e]), (9, None), (10, []), (11, [0.0, 0.0, *e]),
        (12, [float("nan"), 1.0, *e]), (13, [float("inf"), 1.0, *e]), (14, [None, 1.0, *e]), (None, [1.0, 0.0, *e]), (None, None),
        (7, [0.0, 1.0, *e]), (7, [0.0, 1.0, *e]), (15, [1e-300, 0.0, *e]), (16, [1e300, 0.0, *e]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("cls", "vector", "kept", "root", "times")})
    assert got(itq.groups(df)) == sorted(brute(rows), key=str)
    # another length than the common one links with nothing
    mixed = spark.createDataFrame([*rows, (20, [1.0, 2.0]), (21, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r[:3] for r in got(itq.groups(mixed)) if r[0] in (20, 21)} == {(20, 0, 20), (21, 0, 21)}
    assert itq.groups(df.limit(0)).count() == 0
    assert got(itq.groups(df.where("vec_id in (9, 10)"))) == [(10, 0, 10, True), (9, 0, 9, True)]


def test_codes_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 64)) * np.linspace(1, 3, 64) + 2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = itq.fit(x).codes(x)
    bits = np.unpackbits(codes.view(np.uint8), axis=1)
    assert codes.shape == (4000, 2)
    assert np.abs(bits.mean(0) - 0.5).max() < 0.1

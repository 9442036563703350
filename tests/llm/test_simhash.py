"""SimHash groups against all pairs."""

import random

import numpy as np
import pytest
from odd_rows import CLASHES, ROWS
from xxhash import xxh64_intdigest

from tapeworks.llm import simhash
from tapeworks.llm._graph import components


def plain_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    out = 0
    for b in range(64):
        if 2 * sum(xxh64_intdigest(s, 42) >> b & 1 for s in shingles) > len(shingles):
            out |= 1 << b
    return out


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(rows, radius=3):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius])
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, f, least.get(r)) for (i, _), f, r in zip(rows, fps, root)]


def got(df):
    return sorted(((r.id, r.fp % 2**64, r.component_id) for r in df.collect()), key=str)


def test_documents(documents, odd, empty):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(simhash.groups(documents)) == sorted(brute(rows), key=str)
    assert got(simhash.groups(odd)) == sorted(brute([r[:2] for r in ROWS]), key=str)
    assert simhash.groups(empty).count() == 0


def test_keep_one(odd, empty, documents):
    kept = simhash.keep_one(odd)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    groups = {}
    for i, f, c in brute([r[:2] for r in ROWS]):
        groups.setdefault((c, f if c is None else None), i)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((k[0] for k in groups), key=str)
    assert simhash.keep_one(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert {r.doc_id for r in simhash.keep_one(documents).collect()} == {c for _, _, c in brute(rows)}


@pytest.mark.parametrize("cell_rows", [3, 10_000])
def test_links_of_clusters(spark, cell_rows):
    rng = random.Random(3)
    points = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            x = centre
            for _ in range(rng.randint(0, 7)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
    points = sorted(points | {0, 1, 2**64 - 1, 2**63})
    signed = [p - (p >> 63 << 64) for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(5)
    want = union(len(points), [(a, b) for a in range(len(points)) for b in range(a) if (points[a] ^ points[b]).bit_count() <= 3])
    edges = [(r.fp, r.root) for r in simhash.links(df, cell_rows=cell_rows).collect()]
    place = {s: k for k, s in enumerate(signed)}
    assert union(len(points), [(place[a], place[b]) for a, b in edges]) == want


def test_forest_finds_all_within():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 2**12, 400, dtype=np.uint64)
    group = np.sort(rng.integers(0, 5, 400))
    forest = simhash.Forest(points, group)
    found = {(int(a), int(b)) for some, node in forest.within(points, forest.root_of, 2) for a, b in zip(some, node)}
    assert found == {(a, b) for a in range(400) for b in range(400) if group[a] == group[b] and (int(points[a]) ^ int(points[b])).bit_count() <= 2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(1001, 1200)] + [(5, 5), (-7, -9), (2**62, -(2**63))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert len({got[i] for i in range(301)}) == 1
    assert len({got[i] for i in range(1000, 1200)}) == 1
    assert len(set(got.values())) == 4
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0

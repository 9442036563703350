"""Near copies by five-word similarity, against all pairs."""

import random

import numpy as np
import pytest
from odd_rows import CLASHES, ROWS
from test_simhash import union

from tapeworks.llm import simhash


def plain_set(text, n=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}


def links(rows, least=0.8):
    """Pairs of (id, text) rows by exact similarity; an index of shingles saves hopeless pairs."""
    sets, holds, pairs = [plain_set(t) for _, t in rows], {}, []
    for k, s in enumerate(sets):
        near = set()
        for x in s:
            near.update(holds.get(x, ()))
        pairs += [(k, m) for m in near if len(s & sets[m]) >= least * len(s | sets[m])]
        for x in s:
            holds.setdefault(x, []).append(k)
    return pairs


def brute_kept(rows):
    """Indexes of the rows that stay: of each group the smallest id, rows without an id last."""
    best = {}
    for k, r in enumerate(union(len(rows), links(rows))):
        best[r] = min(best.get(r, k), k, key=lambda x: (rows[x][0] is None, rows[x][0] or 0))
    return sorted(best.values())


@pytest.fixture(scope="module")
def edited():
    """Texts and copies of them with a share of words replaced, dropped or added, in groups from 2 to 60."""
    rng, rows = random.Random(8), []
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    for g in range(60):
        base = [word() for _ in range(rng.choice([30, 90, 200, 400]))]
        for c in range(60 if g == 0 else rng.randint(1, 6)):
            copy, edits = list(base), 0 if c == 0 else rng.randint(0, max(1, len(base) // 40))
            for _ in range(edits):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("cell_rows", [7, 8192])
def test_recall_and_no_false_link(spark, edited, cell_rows):
    df = spark.createDataFrame(edited, "doc_id long, text string").repartition(5)
    found = simhash.similar_classes(df, cell_rows=cell_rows).collect()
    root = {r.b.id: r.root for r in found}
    pairs = links(edited)
    best = {t: i for i, t in reversed(edited)}
    rep = lambda k: root[best[edited[k][1]]]
    caught = [a for a, b in pairs if edited[a][1] == edited[b][1] or (rep(a) is not None and rep(a) == rep(b))]
    assert len(pairs) > 300 and len(caught) >= 0.97 * len(pairs)
    exact = union(len(edited), pairs)
    groups = {}
    for k in range(len(edited)):
        if rep(k) is not None:
            groups.setdefault(rep(k), set()).add(exact[k])
    assert all(len(g) == 1 for g in groups.values())


def test_documents(documents, odd, empty):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = [rows[k][0] for k in brute_kept(rows)]
    assert sorted(r.doc_id for r in simhash.keep_similar(documents).collect()) == want and len(want) < len(rows)
    kept = simhash.keep_similar(odd)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    some = [r[:2] for r in ROWS]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((some[k][0] for k in brute_kept(some)), key=str)
    assert simhash.keep_similar(empty).count() == 0


def test_similarity_and_shards():
    a, b = simhash.shingles("A b c d e f g"), simhash.shingles("a b c d e f h")
    assert len(a) == 3 and simhash.similarity(a, b) == 0.5 and simhash.similarity(a, a) == 1
    rng = np.random.default_rng(1)
    for radius, agree in ((9, 2), (3, 2), (9, 3)):
        masks = simhash.shard_masks(radius, agree)
        flips = np.array([sum(1 << int(x) for x in rng.choice(64, radius, replace=False)) for _ in range(300)], np.uint64)
        assert (simhash._first_shard(flips, masks) >= 0).all()

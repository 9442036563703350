"""Pfair mixing: shares, deadlines, and whole results."""

from collections import Counter, defaultdict

import pytest
from odd_rows import CLASHES, ROWS
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeworks.llm import mixing


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(1, 40), min_size=1, max_size=12))
def test_period_is_never_a_block_off(weights):
    slots, whole = mixing.period(weights), sum(weights.values())
    assert sorted(x for own in slots.values() for x in own) == list(range(whole))
    for s, w in weights.items():
        for k, slot in enumerate(slots[s]):
            assert k * whole // w <= slot < -(-(k + 1) * whole // w)
        for t in range(whole + 1):
            assert abs(sum(x < t for x in slots[s]) - t * w / whole) < 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcd", min_size=1, max_size=2), st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=6))
def test_phases_place_every_block(sources):
    blocks = {s: b for s, (b, _) in sources.items()}
    weights = {s: w for s, (_, w) in sources.items()}
    used = Counter()
    for s, n in blocks.items():
        for k in range(n):
            p = [p for p in mixing.phases(blocks, weights) if s in p.weights and p.first[s] <= k][-1]
            turn, place = divmod(k - p.first[s], p.weights[s])
            used[p.at + turn * sum(p.weights.values()) + p.slots[s][place]] += 1
    assert used == Counter(range(sum(blocks.values())))


def test_whole_weights():
    got = mixing.whole_weights({"a": 1, "b": 2, "c": 0}, 64)
    assert sum(got.values()) == 64 and min(got.values()) >= 1
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": 1, "b": 2}, 1)


def running(rows, block):
    """Expected block of each row of a source, by id."""
    at, out = 0, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        out[r.doc_id] = at // block
        at += len(r.text.encode()) + 1
    return out


def test_documents(documents):
    rows = documents.collect()
    weights = {f"src{i}": i + 1 for i in range(20)}
    got = mixing.schedule(documents, weights, block_bytes=4096).collect()
    assert sorted(r.id for r in got) == sorted(r.doc_id for r in rows)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    blocks = {s: running(own, 4096) for s, own in by_source.items()}
    used = defaultdict(set)
    for r in got:
        assert r.block == blocks[r.src[1:]][r.id]
        assert r.release <= r.slot < r.deadline
        used[r.slot].add((r.src, r.block))
    assert all(len(v) == 1 for v in used.values())
    # until a source runs dry each source is within a block of its share
    first = min((r.phase_at for r in got if r.phase_at > 0), default=max(used) + 1)
    share = {r.src: r.weight / r.of_weights for r in got if r.phase_at == 0}
    full = {x for v in used.values() for x in v}
    done = Counter()
    for t in range(first):
        for s, w in share.items():
            # blocks that a long document runs through have no row
            assert done[s] - t * w < 1
        for s, _ in used.get(t, ()):
            done[s] += 1
    assert full


def test_odd_rows(odd, empty):
    got = mixing.schedule(odd, block_bytes=32).collect()
    assert sum(r.copies for r in got) == len(ROWS)
    assert len({(r.src, r.block) for r in got}) == len({r.slot for r in got})
    out = mixing.mix(odd)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    assert sorted((r[:5] for r in map(tuple, out.collect())), key=str) == sorted(ROWS, key=str)
    for df in (mixing.schedule(empty), mixing.mix(empty)):
        assert df.count() == 0


def test_mix_follows_the_slots(documents):
    slot = {r.id: (r.slot, r.before) for r in mixing.schedule(documents, block_bytes=8192).collect()}
    order = [slot[r.doc_id] for r in mixing.mix(documents, block_bytes=8192).collect()]
    assert order == sorted(order)

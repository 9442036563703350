"""Baum-Welch over pieces against a plain row-by-row version; known chains; scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_market import chain_frame, sample_chain

from tapeworks.functions.scan import order_cuts
from tapeworks.operators import baum_welch, regime

ORDER = ["event_time", "event_id"]


def plain(x, c, rounds):
    """Log-likelihoods before each round, and the last parameters, row by row."""
    z, k, history = (x - c.center) / c.scale, len(c.pi), []
    pi, a, mu, cov = c.pi, c.trans, c.mu, c.cov
    for _ in range(rounds):
        b = np.exp(regime.emission(z, mu, cov))
        f, g, scale = np.zeros_like(b), np.ones_like(b), np.zeros(len(z))
        for t in range(len(z)):
            f[t] = (pi if t == 0 else f[t - 1] @ a) * b[t]
            scale[t] = f[t].sum()
            f[t] /= scale[t]
        for t in range(len(z) - 2, -1, -1):
            g[t] = a @ (b[t + 1] * g[t + 1]) / scale[t + 1]
        history.append(np.log(scale).sum())
        post = f * g
        pairs = sum(np.outer(f[t], b[t + 1] * g[t + 1]) * a / scale[t + 1] for t in range(len(z) - 1))
        n = post.sum(0)
        pi, a, mu = post[0], pairs / pairs.sum(1, keepdims=True), post.T @ z / n[:, None]
        cov = np.stack([(post[:, i, None] * (z - mu[i])).T @ (z - mu[i]) / n[i] for i in range(k)])
    return history, pi, a, mu, cov


@pytest.fixture
def short_pieces(monkeypatch):
    monkeypatch.setattr(baum_welch, "ROWS_PER_PIECE", 37)


def test_equals_row_by_row(spark, short_pieces):
    _, x, _, _ = sample_chain(500, 4)
    obs = chain_frame(spark, x).unionByName(chain_frame(spark, x[:260] * 2 + 1).withColumn("instrument", F.lit("B")))
    cuts = order_cuts(obs, ORDER, blocks=3)
    pieces = baum_welch.packed(obs, cuts=cuts)
    assert pieces.where("instrument = 'A'").count() >= 14 and pieces.where("is_first").count() == 2
    first = baum_welch.starts(obs, 2)
    got = baum_welch.refine(pieces, first, rounds=3, tolerance=-np.inf).collect()
    begun = {(r.instrument, r.start): r.asDict() for r in first.collect()}
    assert len(got) == 4
    for r in got:
        rows = x if r.instrument == "A" else x[:260] * 2 + 1
        history, pi, a, mu, cov = plain(rows, regime.Chain(begun[r.instrument, r.start]), 3)
        assert r.history == pytest.approx(history, rel=1e-10)
        for have, want in ((r.pi, pi), (r.trans, a), (r.means, mu), (r.covars, cov)):
            assert np.allclose(have, np.ravel(want), atol=1e-8)
    # the log-likelihood of a given model, over any cuts
    best = spark.createDataFrame(got).where("start = 0")
    for r in baum_welch.score(obs, best).collect():
        rows = x if r.instrument == "A" else x[:260] * 2 + 1
        own = next(g.asDict() for g in got if (g.instrument, g.start) == (r.instrument, 0))
        assert r.loglik == pytest.approx(plain(rows, regime.Chain(own), 1)[0][0], rel=1e-10)


def test_recovers_a_known_chain(spark):
    z, x, a, mu = sample_chain(3000, 6)
    m = baum_welch.fit_hmm(chain_frame(spark, x), n_starts=4, rounds=10, tolerance=1e-3).collect()
    assert len(m) == 1 and m[0].n_obs == 3000
    c = regime.Chain(m[0].asDict())
    found = c.mu * c.scale + c.center
    order = [int(np.abs(found - want).sum(1).argmin()) for want in mu]
    assert sorted(order) == [0, 1, 2]
    assert np.allclose(found[order], mu, atol=.05) and np.allclose(c.trans[np.ix_(order, order)], a, atol=.03)
    assert (np.diff(m[0].history) >= -1e-9).all() and m[0].loglik >= m[0].history[-1] - 1e-9
    # the model serves the filter like any other
    probs = np.array([r.probs for r in regime.causal_filter(chain_frame(spark, x), spark.createDataFrame(m)).orderBy("event_time").collect()])
    assert (np.array(order)[z] == probs.argmax(1)).mean() > .95


def test_likelihood_never_falls(spark):
    """Discrete, flat and nearly equal values, where covariances reach their floor."""
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 3, 400), np.ones(400), np.repeat([0.0, 1.0], 200) + rng.integers(0, 2, 400) * 1e-6])
    obs = chain_frame(spark, x)
    pieces = baum_welch.packed(obs)
    for r in baum_welch.refine(pieces, baum_welch.starts(obs, 3), rounds=5, tolerance=-np.inf).collect():
        assert len(r.history) == 5 and np.isfinite(r.history).all()
        assert (np.diff(r.history) >= -1e-7).all()


def test_starts_are_spread_and_small_keys_have_none(spark):
    _, x, _, _ = sample_chain(400, 8)
    obs = chain_frame(spark, x).unionByName(chain_frame(spark, x[:50]).withColumn("instrument", F.lit("B")))
    rows = baum_welch.starts(obs, 8).collect()
    assert {r.instrument for r in rows} == {"A"} and len(rows) == 8
    assert len({tuple(r.means) for r in rows}) > 4
    z = (x - rows[0].center) / rows[0].scale
    for r in rows:
        c = np.array(r.means).reshape(3, 3)
        assert all(np.abs(z - m).sum(1).min() < 1e-9 for m in c)  # a centre is a row
        assert min(np.abs(c[i] - c[j]).sum() for i in range(3) for j in range(i)) > 0
    assert baum_welch.starts(obs.where("false"), 2).count() == 0
    assert baum_welch.fit_hmm(obs.where("instrument = 'B'"), n_starts=2, rounds=2).count() == 0


def test_equal_rows(spark):
    obs = chain_frame(spark, np.zeros((250, 3)))
    m = baum_welch.fit_hmm(obs, n_starts=2, rounds=3).collect()
    assert len(m) == 1 and np.isfinite(m[0].loglik)

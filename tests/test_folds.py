"""Sweeps and folds from one replay per threshold, against a replay of every part on its own."""

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import research
from tapeworks.operators.ledger import signed_positions
from tapeworks.plans import views


def replayed(features, threshold, size):
    """Fills, realized, net and closes of one combination over these rows alone, from flat."""
    fills = research.sweep_fills(features, thresholds=(threshold,), sizes=(size,))
    pos = signed_positions(fills, key=("combo", "instrument"))
    net = F.col("realized") - F.col("transaction_cost")
    return pos.agg(F.count("*"), F.sum("realized"), F.sum(net), F.avg(F.when(F.col("opposes"), (net > 0).cast("double")))).first()


def test_folds_and_sweep(spark, sf):
    f = views.features(spark, sf)
    folds, thresholds, sizes = 2, (0.5, 0.8), (0.01, 3.0)
    got = {(r.fold, r.part, r.combo): r for r in research.fold_results(f, folds=folds, thresholds=thresholds, sizes=sizes).collect()}
    assert len(got) == folds * 2 * len(thresholds) * len(sizes)
    chunked = research.folds_of(f, folds)
    for part, fold, rows in (("train", 2, chunked.where("chunk < 2")), ("test", 1, chunked.where("chunk = 1"))):
        n, realized, net, hit = replayed(rows, 0.8, 3.0)
        r = got[fold, part, "t0.8_s3.0"]
        assert (r.fills, r.realized_pnl, r.net_pnl, r.hit_rate) == (n, pytest.approx(realized), pytest.approx(net), pytest.approx(hit or 0.0))
    whole = {r.combo: r for r in research.parameter_sweep(f, thresholds=thresholds, sizes=sizes).collect()}
    n, realized, net, hit = replayed(f, 0.5, 0.01)
    r = whole["t0.5_s0.01"]
    assert (r.fills, r.realized_pnl, r.net_pnl) == (n, pytest.approx(realized), pytest.approx(net))
    big = whole["t0.5_s3.0"]
    assert big.hit_rate == r.hit_rate and big.avg_hold_secs == r.avg_hold_secs and big.turnover == pytest.approx(300 * r.turnover)

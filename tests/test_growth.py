"""Work that must not grow faster than the rows: what is derived once, and what a task may hold."""

from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import baum_welch, ml, regime, research, risk
from tapeworks.plans import market, registry, views

START = datetime(2024, 1, 1)


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_composite_deals_rows_by_key_not_by_alpha(spark):
    rows = [("B", START + timedelta(minutes=i), f"e{i}", a, s) for i in range(50) for a, s in (("x", i / 50), ("y", -0.02))]
    alphas = spark.createDataFrame(rows, "instrument string, event_time timestamp, event_id string, alpha string, signal double")
    out = research.composite(alphas, spark.createDataFrame([("x", 0.5), ("y", 1.0)], "alpha string, weight double"))
    plan = physical(out)
    assert "hashpartitioning(alpha" not in plan and "BroadcastHashJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # and both steps of the sum come after it
    got = {r["event_id"]: r for r in out.collect()}
    assert len(got) == 50 and all(r["alphas"] == 2 for r in got.values())
    assert got["e10"]["score"] == pytest.approx(0.08) and got["e10"]["entry"] == "BUY" and got["e4"]["entry"] is None


def test_training_set_reads_written_matches(spark, sf):
    s = ml.build_training_set(views.quick_fills(spark, sf), views.features(spark, sf))
    # neither labels nor entries match or join in time again
    assert "Window" not in planned(s) and "get_json_object" not in planned(s)


def test_split_is_scanned_once(spark):
    rows = [(f"s{i:02d}", START + timedelta(hours=i), START + timedelta(hours=i - 2)) for i in range(25)]
    s = spark.createDataFrame(rows, "entry_id string, label_time timestamp, feature_event_time timestamp")
    out = ml.temporal_split(s)
    assert "Window" not in planned(out)
    # rank k is valid when its label (hour k - 1) is there before the next row's features (hour k - 2)
    assert out.where("is_train").count() == 1 and out.count() == 25


def test_assembly_joins_written_bars(spark, sf, monkeypatch):
    seen = []
    join = market.asof_join

    def noted(left, right, **how):
        seen.append(planned(left))
        return join(left, right, **how)

    monkeypatch.setattr(market, "asof_join", noted)
    monkeypatch.setattr(registry, "_SHARED", {})
    market.assembled(spark, sf)
    assert len(seen) == 3 and not any("Window" in p or "Join" in p for p in seen)


def test_poisson_weights_equal_the_stated_hash():
    h = np.concatenate([np.random.default_rng(5).integers(0, risk.PRIME, 500), [0, 1, risk.PRIME - 1]])
    s = np.arange(300)
    want = [[sum(u >= step for step in risk.POISSON_STEPS) for u in row] for row in risk._uniform(h[:40, None], s[None, :]).tolist()]
    assert risk.poisson_weights(h, s)[:40].tolist() == want
    full = np.searchsorted(risk.POISSON_STEPS, risk._uniform(h[:, None], s[None, :]), side="right")
    assert (risk.poisson_weights(h, s) == full).all()


def test_moments_over_tiles_of_simulations(spark):
    rows = spark.createDataFrame([(i * 7919, (i % 13) - 6.0) for i in range(200)], "id long, net_pnl double")
    got = risk.bootstrap_moments(rows, id_hash=F.col("id"), n_sims=1100).orderBy("sim").toPandas()
    h, r = np.arange(200) * 7919, np.arange(200) % 13 - 6.0
    w = np.searchsorted(risk.POISSON_STEPS, risk._uniform(h[:, None], np.arange(1100)[None, :]), side="right")
    assert got["sim"].tolist() == list(range(1100))
    np.testing.assert_allclose(got[["w", "wr", "wrr"]].to_numpy(), np.stack([w.sum(0), r @ w, (r * r) @ w], 1), atol=1e-9)


def test_pieces_come_straight_from_arrow():
    x = np.arange(18.0)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "xs": [x[:6].tolist(), x[6:].tolist()]})
    (a, first), (b, second) = baum_welch._rows(batch, ["id"])
    assert (a, b) == ({"id": 1}, {"id": 2}) and first.tolist() == x[:6].reshape(-1, 3).tolist()
    assert second.shape == (4, 3) and second.dtype == float


def test_densities_equal_scalar_ones():
    rng = np.random.default_rng(2)
    x, mu = rng.normal(size=(7, 3)), rng.normal(size=(2, 3))
    cov = np.stack([a @ a.T + np.eye(3) for a in rng.normal(size=(2, 3, 3))])
    for t, row in enumerate(regime.emission(x, mu, cov)):
        for k in range(2):
            d = x[t] - mu[k]
            want = -0.5 * (d @ np.linalg.inv(cov[k]) @ d + np.log(np.linalg.det(cov[k])) + 3 * np.log(2 * np.pi))
            assert row[k] == pytest.approx(want)

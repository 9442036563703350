"""Point-in-time safety, execution cost, decisions, models, regimes, news, streaming."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import decisions, ml, news, regime, research, signals, store, tca
from tapeworks.session import durable_dir
from tapeworks.streaming import jobs


def ts(text):
    return pd.Timestamp(text).to_pydatetime()


def test_late_correction_is_not_seen_early(spark):
    s = spark.createDataFrame(
        [("e1", "A", ts("2024-01-01 10:00"), ts("2024-01-01 10:00"), .10),
         ("e2", "A", ts("2024-01-01 10:00"), ts("2024-01-02 10:00"), .11),
         ("e3", "A", ts("2024-01-03 10:00"), ts("2024-01-01 09:00"), .99)],
        "event_id string, instrument string, event_time timestamp, ingest_time timestamp, obi double")
    seen = lambda t: [r.obi for r in store.features_as_of(s, t).collect()]
    assert seen("2024-01-01 09:30") == []
    assert seen("2024-01-01 12:00") == [.10]
    assert seen("2024-01-02 12:00") == [.11]
    assert seen("2024-01-03 10:00") == [.99]
    grid = spark.createDataFrame([(str(i), "A", ts(t)) for i, t in enumerate(
        ["2024-01-01 09:30", "2024-01-01 12:00", "2024-01-02 12:00", "2024-01-03 10:00"])],
        "spine_id string, instrument string, decision_time timestamp")
    j = store.pit_join(grid, s, take=["obi"])
    assert [r.obi for r in j.orderBy("spine_id").collect()] == [None, .10, .11, .99]
    assert store.lookahead_audit(j).count() == 0
    leaky = j.withColumn("feature_ingest_time", F.col("decision_time") + F.expr("interval 1 second"))
    assert store.lookahead_audit(leaky).count() == 4


@pytest.mark.parametrize("side, price, bps", [("BUY", 101, 100), ("BUY", 99, -100), ("SELL", 99, 100), ("SELL", 101, -100)])
def test_arrival_slippage_signs(spark, side, price, bps):
    f = spark.createDataFrame(
        [("x", "A", side, 1.0, float(price), 0.0, 0.0, ts("2024-01-01 00:00:30"))],
        "execution_id string, instrument string, side string, quantity double, fill_price double, transaction_cost double, "
        "slippage_bps double, ts timestamp")
    t = spark.createDataFrame([("t1", "A", 100.0, ts("2024-01-01 00:00:00")), ("t2", "A", 500.0, ts("2024-01-01 00:00:31"))],
                              "tick_id string, instrument string, price double, ts timestamp")
    row = tca.tca_per_fill(tca.arrival_join(f, t)).first()
    assert row.slippage == pytest.approx(bps) and row.slippage_source == "arrival"
    far = tca.tca_per_fill(tca.arrival_join(f.withColumn("ts", F.expr("ts + interval 1 hour")), t.where("price < 200"))).first()
    assert far.slippage is None and far.shortfall == 0
    told = tca.tca_per_fill(tca.arrival_join(f.withColumn("slippage_bps", F.lit(7.5)), t)).first()
    assert told.slippage == 7.5 and told.slippage_source == "reported"


def test_impact_schedule_and_capacity_laws(spark):
    est = spark.createDataFrame([("A", .02, 1e8, "e", "e")], "instrument string, sigma double, adv double, sigma_basis string, adv_basis string")
    o = spark.createDataFrame([(1, "A", 1e6, 8), (2, "A", 4e6, 1), (3, "B", 1e6, 3)], "order_id int, instrument string, notional double, slices int")
    i = {r.order_id: r for r in tca.impact(o, est).collect()}
    assert i[2].temporary_bps == pytest.approx(2 * i[1].temporary_bps)
    assert i[2].permanent_bps == pytest.approx(4 * i[1].permanent_bps)
    assert i[3].sigma_basis == "default: no fills"
    for risk_aversion in (0.0, 1.0, 1e9):
        s = tca.execution_schedule(o, est, risk_aversion=risk_aversion).where("order_id = 1").orderBy("slice").collect()
        child = [r.child for r in s]
        assert sum(child) == pytest.approx(1e6) and s[-1].cumulative == pytest.approx(1e6)
        assert all(a >= b - 1e-6 for a, b in zip(child, child[1:]))
        if risk_aversion == 0:
            assert child == pytest.approx([125000.0] * 8)
        if risk_aversion == 1e9:
            assert child[0] == pytest.approx(1e6)
    c = tca.capacity(est).first()
    assert c.impact_bps == pytest.approx(10)
    assert tca.capacity(est, edge_bps=0.0).first().capacity is None


def test_decision_on_the_threshold_is_not_counted(spark):
    f = spark.createDataFrame([("e1", .9, 0., 0., 50., 1.), ("e2", .95, .003, 0., 50., 1.), ("e3", -.95, 0., 0., 90., 1.),
                               ("e4", .96, 0., .02, 50., 4.), ("e5", .93, 0., .02, 50., 1.)],
                              "event_id string, obi double, momentum double, volatility double, fearGreed double, volumeRatio double"
                              ).withColumn("midPrice", F.lit(100.0))
    got = {r.event_id: r for r in decisions.explain_decisions(decisions.decide(f)).collect()}
    assert (got["e1"].type, got["e1"].counted, got["e1"].explanation) == ("no_signal", False, "")
    assert [got[e].blocked_by for e in ("e2", "e3", "e4")] == ["momentum", "sentiment", "volume_spike"]
    assert got["e5"].type == "no_signal" and got["e5"].counted


def test_empty_book(spark):
    lv = "array<struct<price:double,qty:double>>"
    b = spark.createDataFrame([(1, [], []), (2, [(99.0, 3.0)], [(101.0, 1.0)])], f"book_id int, bids {lv}, asks {lv}")
    r = {x.book_id: x for x in signals.order_book_imbalance(b).collect()}
    assert r[1].obi == 0 and r[1].mid == 0
    assert r[2].obi == .5 and r[2].mid == 100 and r[2].micro_price == pytest.approx((99 * 1 + 101 * 3) / 4)


def test_temporal_split_never_trains_on_the_future(spark):
    rows = [(f"s{i:02d}", ts("2024-01-01") + pd.Timedelta(hours=i), ts("2024-01-01") + pd.Timedelta(hours=i - (30 if i == 20 else 2)))
            for i in range(25)]
    s = spark.createDataFrame(rows, "entry_id string, label_time timestamp, feature_event_time timestamp")
    out = ml.temporal_split(s).toPandas()
    train, test = out[out.is_train], out[~out.is_train]
    assert len(train) >= 1 and len(test) >= 1
    assert len(train) == 1 or train.label_time.max() <= test.feature_event_time.min()


def test_psi_and_gate(spark):
    a = spark.createDataFrame([(float(i % 50),) for i in range(1000)], "x double")
    assert ml.psi(a, a, features=["x"]).first().psi == pytest.approx(0)
    assert ml.psi(a, a.withColumn("x", F.col("x") / 5), features=["x"]).first().psi > 1
    s = spark.createDataFrame([(i % 2, i % 2, 1) for i in range(20)], "label int, prediction int, old int")
    assert ml.promotion_gate(s, incumbent="old").first().reason == "better"
    assert ml.promotion_gate(s.where("label = 1")).first().reason == "single_class"
    assert ml.promotion_gate(s.limit(4)).first().reason == "too_few_positives"


def test_model_round_trip(spark, tmp_path):
    rows = [(float(i % 10), float(i % 7), int(i % 10 > 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    assert ml.train_classifier(df.limit(5), features=["a", "b"], rounds=2) is None
    m = ml.train_classifier(df, features=["a", "b"], rounds=3)
    ml.save_model(spark, m, str(tmp_path / "m"), trained_at="2024-01-01", samples=200, features=["a", "b"])
    again = ml.load_model(spark, str(tmp_path / "m"), features=["a", "b"])
    one = lambda model: [round(r.confidence, 9) for r in ml.score(model, df).orderBy("a", "b").collect()]
    assert one(again) == one(m)
    assert ml.load_model(spark, str(tmp_path / "m"), features=["a"]) is None


def test_gate_against_the_stored_model(spark, tmp_path):
    """The stored model stays unless a candidate is better on the same test rows."""
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (900, 2))
    rows = [(float(a), float(b), int(a > 0)) for a, b in x]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    test, flipped = df.limit(300), df.withColumn("label", 1 - F.col("label"))
    fit = lambda d: ml.train_classifier(d, features=["a", "b"], rounds=3)
    good, bad = fit(df), fit(flipped)
    gate = lambda m: ml.gate_against_stored(spark, m, str(tmp_path / "g"), test, trained_at="t", samples=900, features=["a", "b"]).first()
    assert [gate(bad).reason, gate(bad).reason, gate(good).reason, gate(bad).reason] == ["first_model", "no_improvement", "better", "no_improvement"]
    last = gate(good)
    assert (last.reason, last.promote, last.challenger_accuracy) == ("no_improvement", False, last.incumbent_accuracy) and last.challenger_accuracy > .9
    assert gate(None).reason == "not_trained"
    scored = ml.score(good, test)
    m, rows = ml.classifier_metrics(scored).first(), scored.select("label", "prediction").collect()
    assert (m.tp, m.fn) == (sum(r.label and r.prediction == 1 for r in rows), sum(r.label and r.prediction == 0 for r in rows))


def test_portfolio_says_why_there_is_none(spark):
    from tapeworks.operators import risk
    rows = [(i, p, r, ts("2024-01-01")) for i, k in (("A", .01), ("B", .03)) for p, r in enumerate([k, -k, k, -k, k, -k], 1)]
    ranked = spark.createDataFrame(rows, "instrument string, pos long, ret double, time timestamp")
    both = risk.portfolio_construction(ranked).orderBy("instrument").collect()
    assert [r.weight for r in both] == pytest.approx([.5, -.5]) and all(r.available and r.reason is None for r in both)
    one = risk.portfolio_construction(ranked.where("instrument = 'A'")).collect()
    assert len(one) == 1 and not one[0].available and "have 1" in one[0].reason and one[0].weight is None
    equal = risk.portfolio_construction(ranked.withColumn("ret", F.when(F.col("pos") % 2 == 0, .01).otherwise(-.01))).first()
    assert not equal.available and "do not differ" in equal.reason
    assert risk.portfolio_construction(ranked.where("false")).first().reason.endswith("have 0")


def sample_chain(n, seed=1):
    rng = np.random.default_rng(seed)
    a = np.array([[.95, .03, .02], [.03, .94, .03], [.02, .03, .95]])
    mu = np.array([[0, .2, .2], [2, 1, .5], [-2, 3, 1.5]], float)
    z = [0]
    for _ in range(n - 1):
        z.append(int(rng.choice(3, p=a[z[-1]])))
    return np.array(z), mu[z] + rng.normal(0, .25, (n, 3)), a, mu


def chain_frame(spark, x, z=None):
    rows = [("A", f"e{i:04d}", ts("2024-01-01") + pd.Timedelta(seconds=i), *map(float, r), int(z[i]) if z is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(
        rows, "instrument string, event_id string, event_time timestamp, x0 double, x1 double, x2 double, state int")


def test_labelled_fit_recovers_parameters(spark):
    z, x, a, mu = sample_chain(1500)
    m = regime.models_from(regime.state_sums(chain_frame(spark, x, z))).first()
    c = regime.Chain(m.asDict())
    assert np.allclose(c.mu * c.scale + c.center, mu, atol=.05)
    assert np.allclose(c.trans, a, atol=.03) and c.pi.sum() == pytest.approx(1)
    assert regime.models_from(regime.state_sums(chain_frame(spark, x[:50], z[:50]))).count() == 0


def one_pass(x, c):
    """Forward and backward row by row, and the best path by back-pointers."""
    b = regime.emission((x - c.center) / c.scale, c.mu, c.cov)
    b -= b.max(axis=1, keepdims=True)
    e, n = np.exp(b), len(x)
    f, g = np.zeros_like(e), np.ones_like(e)
    for t in range(n):
        f[t] = (c.pi if t == 0 else f[t - 1] @ c.trans) * e[t]
        f[t] /= f[t].sum()
    for t in range(n - 2, -1, -1):
        g[t] = c.trans @ (e[t + 1] * g[t + 1])
        g[t] /= g[t].sum()
    s, back = np.log(c.pi) + b[0], []
    for t in range(1, n):
        step = s[:, None] + np.log(c.trans)
        back.append(step.argmax(axis=0))
        s = step.max(axis=0) + b[t]
    path = [int(s.argmax())]
    for p in reversed(back):
        path.append(int(p[path[-1]]))
    sm = f * g
    return f, sm / sm.sum(axis=1, keepdims=True), path[::-1]


def test_blocked_chains_equal_one_pass(spark):
    from tapeworks.functions.scan import order_cuts
    z, x, _, _ = sample_chain(400, 2)
    obs = chain_frame(spark, x, z).withColumn("other", F.lit("B"))
    other = obs.withColumn("instrument", F.col("other")).limit(5)
    models = regime.models_from(regime.state_sums(obs))
    both = obs.unionByName(other)
    want = one_pass(x, regime.Chain(models.first().asDict()))
    for blocks in (1, 7):
        cuts = order_cuts(both, ["event_time", "event_id"], blocks=blocks)
        run = lambda f: f(both, models, cuts=cuts).orderBy("instrument", "event_time").collect()
        filtered, smoothed, path = run(regime.causal_filter), run(regime.smooth), run(regime.decode)
        assert np.allclose([r.probs for r in filtered[:400]], want[0], atol=1e-9)
        assert np.allclose([r.smoothed for r in smoothed[:400]], want[1], atol=1e-9)
        assert [r.path for r in path[:400]] == want[2]
        # no model for the other key: its rows stay, without a state
        assert [r.probs for r in filtered[400:]] == [None] * 5 and [r.state for r in filtered[400:]] == [None] * 5
    assert (np.array(want[2]) == z).mean() > .95


def test_history_never_sees_later_rows(spark):
    """Later rows, however different, change nothing about earlier ones: their labels, models and states."""
    from tapeworks.functions.scan import order_cuts
    z, x, _, _ = sample_chain(900, 3)
    wild = x.copy()
    wild[500:] = wild[500:] * 9 - 40
    run = lambda rows, **p: [(r.epoch, r.probs, r.state) for r in regime.regime_history(chain_frame(spark, rows).drop("state"), min_obs=100, **p).orderBy("event_time").collect()]
    whole, other, cut = run(x), run(wild), run(x[:500])
    assert len(whole) == 900 and [e for e, _, _ in whole] == [0] * 100 + [1 + i // 50 for i in range(800)]
    assert [p is None for _, p, _ in whole] == [True] * 100 + [False] * 800
    for a, b, c in zip(whole[:500], other, cut):
        assert a[0] == b[0] == c[0] and a[2] == b[2] == c[2]
        assert a[1] is None or (np.allclose(a[1], b[1], atol=1e-9) and np.allclose(a[1], c[1], atol=1e-9))
    assert any(not np.allclose(a[1], b[1], atol=1e-3) for a, b in zip(whole[500:], other[500:]))
    obs = chain_frame(spark, x).drop("state")
    blocked = run(x, cuts=order_cuts(obs, ["event_time", "event_id"], blocks=7))
    assert all(a[1] is None or np.allclose(a[1], b[1], atol=1e-9) for a, b in zip(whole, blocked))


def test_history_row_by_row(spark):
    """Against a plain replay that refits on the rows so far."""
    z, x, _, _ = sample_chain(260, 5)
    obs = chain_frame(spark, x).drop("state")
    got = regime.regime_history(obs, min_obs=100, refit=40).orderBy("event_time").collect()
    first, v, state = 100, None, np.zeros(260, int)
    bands = lambda rows: (rows[:, 1].mean(), rows[:, 1].std())
    for n in range(260):
        epoch = 0 if n < first else 1 + (n - first) // 40
        m, s = bands(x[:first] if epoch == 0 else x[:first + (epoch - 1) * 40])
        state[n] = int((x[n, 1] - m) / s > -.5) + int((x[n, 1] - m) / s > .5)
    for n in range(first, 260):
        upto = first + (n - first) // 40 * 40
        past, lab = x[:upto], state[:upto]
        c, w = past.mean(0), past.std(0)
        p = (np.bincount(lab, minlength=3) + 1) / (upto + 3)
        t = np.ones((3, 3))
        np.add.at(t, (lab[:-1], lab[1:]), 1)
        t /= t.sum(1, keepdims=True)
        zs = [(past[lab == k] - c) / w for k in range(3)]
        mu = np.stack([q.mean(0) if len(q) > 1 else np.zeros(3) for q in zs])
        cov = np.stack([(np.cov(q.T, bias=True) if len(q) > 1 else np.eye(3)) + 1e-3 * np.eye(3) for q in zs])
        b = regime.emission(((x[n] - c) / w)[None], mu, cov)[0]
        v = (p if v is None else v @ t) * np.exp(b - b.max())
        v /= v.sum()
        assert np.allclose(got[n].probs, v, atol=1e-8), n


def test_stationary_distribution(spark):
    df = spark.createDataFrame([([.9, .1, .2, .8],)], "trans array<double>")
    assert df.select(regime.stationary_distribution(F.col("trans"))).first()[0] == pytest.approx([2 / 3, 1 / 3])


def test_news_parsing(spark):
    rows = [(1, '```json\n{"btc": "Bullish", "btc_confidence": 1.7}\n```'), (2, "no idea"), (3, '{"btc": "moon", "btc_confidence": "x"}'), (4, "{broken")]
    p = news.parse_response(spark.createDataFrame(rows, "headline_id int, response string"))
    got = {r.headline_id: r for r in p.collect()}
    assert (got[1].btc_sentiment, got[1].btc_confidence, got[1].eth_confidence) == ("bullish", 1.0, .5)
    assert [got[i].classified for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert (got[3].btc_sentiment, got[3].btc_confidence) == ("neutral", .5)


def test_unclassified_headlines_do_not_count_as_neutral(spark):
    rows = [(1, "a", ts("2024-01-01"), True, "bullish", .5), (2, "b", ts("2024-01-01"), False, "neutral", .5)]
    p = spark.createDataFrame(rows, "headline_id int, title string, processed_at timestamp, classified boolean, btc_sentiment string, btc_confidence double")
    s = news.sentiment(p, "2024-01-01 00:30:00", coins=("btc",)).first()
    assert s.score == 1 and s.headlines == 1 and s.unclassified == 1 and s.latest_headline == "b"


def test_strategies_are_columns():
    assert {"threshold", "vwap_deviation", "ema_crossover", "vpin_breakout", "ou_zscore"} <= set(research.STRATEGIES)


def run_stream(spark, rows, build, files=4, close=None, schema=None):
    """Feed rows in several files, one file per micro-batch; `close` adds a closing row at the end."""
    base = f"{durable_dir(spark)}/t-{np.random.default_rng().integers(1 << 60)}"
    n = len(rows)
    schema = schema or spark.createDataFrame(rows).schema
    for i in range(files):
        part = rows.iloc[i * n // files:(i + 1) * n // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    for day in (100,) if close else ():
        last = [(rows[close].max() + pd.Timedelta(days=day)).to_pydatetime() if f.name == close else None if f.nullable else "" for f in schema]
        spark.createDataFrame([last], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    jobs.use_rocksdb(spark)
    out = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
    out.writeStream.option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").format("parquet").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def test_stream_dedup_across_batches(spark, sf):
    from tapeworks.plans import views
    f = views.fills(spark, sf).limit(200).toPandas()
    twice = pd.concat([f, f]).sort_values("ts", kind="stable")
    assert run_stream(spark, twice, lambda s: jobs.dedup_stream(s), schema=views.fills(spark, sf).schema).count() == len(f)


def test_repeated_batch_adds_nothing_to_the_store(spark, sf):
    from tapeworks.plans import views
    path = f"{durable_dir(spark)}/s-{np.random.default_rng().integers(1 << 60)}"
    write = jobs.store_writer(spark, path)
    rows = views.features(spark, sf)
    write(rows, 0)
    n = spark.read.parquet(path).count()
    write(rows, 0)
    assert spark.read.parquet(path).count() == n == rows.count()

"""Registered queries: bars, signals, point-in-time store, decisions, execution cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.functions.asof import asof_join
from tapeworks.operators import bars, decisions, news, signals, store, tca
from tapeworks.plans import views
from tapeworks.plans.registry import pick, query, shared
from tapeworks.session import materialize


def bars5(spark, sf):
    return bars.bars(views.trade_ticks(spark, sf), "5 minutes")


def signals_of(spark, sf, width):
    name = "signals_" + width.split()[0]
    return shared(spark, sf, name, lambda: signals.bar_signals(bars.bars(views.trade_ticks(spark, sf), width)))


def regimes(spark, sf):
    return shared(spark, sf, "regimes", lambda: signals.classify_regime(signals.return_stats(bars5(spark, sf))))


def estimates(spark, sf):
    return shared(spark, sf, "estimates", lambda: tca.estimates(views.fills(spark, sf)))


def tca_fills(spark, sf):
    return shared(spark, sf, "tca_fills", lambda: tca.tca_per_fill(
        tca.arrival_join(views.fills(spark, sf), views.ticks(spark, sf))))


for _w, _n in (("1 minute", 1), ("5 minutes", 5), ("15 minutes", 15)):
    @query(f"f1_bars_{_n}m", f"""
SELECT instrument, epoch_us(open_time) AS open_us, snap(open, 6) AS open, snap(high, 6) AS high, snap(low, 6) AS low,
  snap(close, 6) AS close, volume, ticks FROM x_bars{_n}""")
    def f1(spark, sf, width=_w):
        return bars.bars(views.trade_ticks(spark, sf), width).transform(
            pick, "instrument", "unix_micros(open_time) open_us", "snap(open, 6) open", "snap(high, 6) high", "snap(low, 6) low",
            "snap(close, 6) close", "volume", "ticks")


@query("f2_vwap", "SELECT instrument, epoch_us(open_time) AS open_us, snap(vwap, 6) AS vwap, volume FROM x_bars1")
def f2(spark, sf):
    return bars.vwap(views.trade_ticks(spark, sf)).transform(
        pick, "instrument", "unix_micros(open_time) open_us", "snap(vwap, 6) vwap", "volume")


@query("f3_f4_order_book", """
SELECT book_id, snap((bv - av) / (bv + av), 6) AS obi, snap(bv, 6) AS bid_volume, snap(av, 6) AS ask_volume,
  snap(best_ask - best_bid, 4) AS spread, snap((best_bid + best_ask) / 2, 4) AS mid, 10 AS levels,
  snap((best_bid * aq1 + best_ask * bq1) / (bq1 + aq1), 6) AS micro_price FROM x_obi""")
def f3(spark, sf):
    return signals.order_book_imbalance(views.books(spark, sf)).transform(
        pick, "book_id", "snap(obi, 6) obi", "snap(bid_volume, 6) bid_volume", "snap(ask_volume, 6) ask_volume",
        "snap(spread, 4) spread", "snap(mid, 4) mid", "levels", "snap(micro_price, 6) micro_price")


@query("f5_f6_momentum", """
SELECT instrument, epoch_us(open_time) AS open_us, snap(ef, 6) AS ema_fast, snap(es, 6) AS ema_slow, snap(momentum, 8) AS momentum,
  CASE WHEN momentum > 0.0005 THEN 'bullish' WHEN momentum < -0.0005 THEN 'bearish' ELSE 'neutral' END AS trend FROM x_sig5""")
def f56(spark, sf):
    return signals_of(spark, sf, "5 minutes").transform(
        pick, "instrument", "unix_micros(open_time) open_us", "snap(ema_fast, 6) ema_fast", "snap(ema_slow, 6) ema_slow",
        "snap(momentum, 8) momentum", "trend")


_MTF = """
SELECT a.*, m1.momentum AS momentum_1m, m15.momentum AS momentum_15m FROM x_sig5 a
ASOF LEFT JOIN x_sig1 m1 ON a.instrument = m1.instrument AND a.close_time >= m1.close_time
ASOF LEFT JOIN x_sig15 m15 ON a.instrument = m15.instrument AND a.close_time >= m15.close_time"""


def multi(spark, sf):
    return shared(spark, sf, "multi", lambda: signals.multi_timeframe_momentum(
        *[signals_of(spark, sf, w) for w in ("1 minute", "5 minutes", "15 minutes")]))


@query("f7_multi_timeframe_momentum", f"""
SELECT instrument, epoch_us(open_time) AS open_us, snap(momentum, 8) AS momentum, snap(momentum_1m, 8) AS momentum_1m,
  snap(momentum_15m, 8) AS momentum_15m FROM ({_MTF})""")
def f7(spark, sf):
    return multi(spark, sf).transform(
        pick, "instrument", "unix_micros(open_time) open_us", "snap(momentum, 8) momentum", "snap(momentum_1m, 8) momentum_1m",
        "snap(momentum_15m, 8) momentum_15m")


@query("f8_atr_volatility", """
SELECT instrument, epoch_us(open_time) AS open_us, snap(atr, 6) AS atr, snap(volatility, 8) AS volatility,
  CASE WHEN n14 < 5 THEN 'unknown' WHEN volatility > 0.015 THEN 'high' WHEN volatility > 0.005 THEN 'medium' ELSE 'low' END AS regime FROM x_sig5""")
def f8(spark, sf):
    return signals_of(spark, sf, "5 minutes").transform(
        pick, "instrument", "unix_micros(open_time) open_us", "snap(atr, 6) atr", "snap(volatility, 8) volatility", "volatility_regime regime")


@query("f9_volume_context", """
SELECT instrument, epoch_us(open_time) AS open_us, snap(volume_ratio, 6) AS volume_ratio, volume_ratio > 2 AS volume_spike FROM x_sig5""")
def f9(spark, sf):
    return signals_of(spark, sf, "5 minutes").transform(
        pick, "instrument", "unix_micros(open_time) open_us", "snap(volume_ratio, 6) volume_ratio", "volume_spike")


@query("f10_oi_change", """
SELECT event_id, snap(coalesce((open_interest - p) / p, 0), 8) AS oi_change FROM (
  SELECT *, lag(open_interest) OVER (PARTITION BY instrument ORDER BY ts, event_id) AS p FROM x_oi)""")
def f10(spark, sf):
    return signals.oi_change(views.open_interest(spark, sf)).transform(pick, "event_id", "snap(oi_change, 8) oi_change")


@query("f11_f12_return_stats", """
SELECT instrument, epoch_us(open_time) AS open_us, n, snap(mean, 9) AS mean, snap(std, 8) AS std FROM x_stats""")
def f11(spark, sf):
    return signals.return_stats(bars5(spark, sf)).transform(
        pick, "instrument", "unix_micros(open_time) open_us", "n", "snap(mean, 9) mean", "snap(std, 8) std")


@query("f13_f14_f15_regime", """
SELECT instrument, epoch_us(open_time) AS open_us, regime, CASE WHEN regime = 'unknown' THEN 0 ELSE snap(vol, 5) END AS volatility_ann,
  CASE WHEN regime = 'unknown' THEN 0.5 ELSE snap(hurst, 5) END AS hurst, CASE WHEN regime = 'unknown' THEN 0 ELSE snap(ac, 5) END AS autocorr,
  snap(confidence, 5) AS confidence FROM x_regime""")
def f15(spark, sf):
    return regimes(spark, sf).transform(
        pick, "instrument", "unix_micros(open_time) open_us", "regime", "snap(volatility_ann, 5) volatility_ann", "snap(hurst, 5) hurst",
        "snap(autocorr, 5) autocorr", "snap(confidence, 5) confidence")


def assembled(spark, sf):
    def build():
        r = regimes(spark, sf).select("instrument", "open_time", "volatility_ann", "hurst", "autocorr", "confidence")
        # each as-of join reads its left side three times: the bars are written between them
        joined = materialize(multi(spark, sf).join(r, ["instrument", "open_time"]), "bars-regimes")
        at = {"left_time": "close_time", "left_uid": "open_time"}
        interest = materialize(signals.oi_change(views.open_interest(spark, sf)).select("instrument", "ts", "event_id", "oi_change"), "interest")
        joined = materialize(asof_join(joined, interest, **at, right_time="ts", right_uid="event_id", take={"oi_change": "oi_change"}), "bars-interest")
        layers = ("fear_greed", "funding_rate", "ml_score", "ml_ready")
        joined = materialize(asof_join(joined, views.market_layers(spark, sf), **at, right_time="ts", right_uid="event_id", take={c: c for c in layers}), "bars-layers")
        mood = news.sentiment_series(news.parse_response(views.headlines(spark, sf))).withColumn("instrument", F.concat(F.upper("coin"), F.lit("-USDT")))
        joined = materialize(asof_join(joined, materialize(mood, "mood"), **at, right_time="at", right_uid="at", take={"news_sentiment": "score"}, tolerance="10 minutes"), "bars-mood")
        return signals.assemble_events(joined, signals.order_book_imbalance(views.books(spark, sf)))
    return shared(spark, sf, "assembled", build)


_VALUES = {
    "obi": "coalesce((bv - av) / (bv + av), 0)", "bidVolume": "coalesce(bv, 0)", "askVolume": "coalesce(av, 0)",
    "spread": "coalesce(best_ask - best_bid, 0)", "midPrice": "coalesce((best_bid + best_ask) / 2, 0)",
    "levels": "CASE WHEN b.book_id IS NULL THEN 0 ELSE 10 END", "momentum": "e.momentum", "momentum1m": "coalesce(momentum_1m, 0)",
    "momentum15m": "coalesce(momentum_15m, 0)", "emaFast": "ef", "emaSlow": "es", "volatility": "e.volatility", "atr": "atr",
    "volumeRatio": "volume_ratio", "fearGreed": "coalesce(f.fearGreed, 50)", "fundingRate": "coalesce((f.seq % 13 - 6) / 10000, 0)",
    "oiChange": "coalesce(o.oi_change, 0)", "mlScore": "coalesce(abs(f.obi), 0.5)", "mlReady": "CASE WHEN f.event_id IS NULL THEN 0 ELSE 1 END",
    "newsSentiment": "CASE WHEN s.mood_ts >= e.close_time - INTERVAL 10 MINUTE THEN score ELSE 0 END",
    "regimeVolAnn": "CASE WHEN r.regime = 'unknown' THEN 0 ELSE vol END", "regimeHurst": "CASE WHEN r.regime = 'unknown' THEN 0.5 ELSE r.hurst END",
    "regimeAutocorr": "CASE WHEN r.regime = 'unknown' THEN 0 ELSE ac END", "regimeConfidence": "confidence",
}


@query("f16_assemble_feature_event", f"""
SELECT e.instrument, epoch_us(e.close_time) AS event_us, {', '.join(f"snap(CAST({x} AS DOUBLE), 5) AS v_{k}" for k, x in _VALUES.items())},
  CASE WHEN b.book_id IS NOT NULL THEN 'orderbook:' || replace(e.instrument, '-', '') || ':' || b.book_id || ',' ELSE '' END
    || 'kline5m:' || replace(e.instrument, '-', '') || ':' || epoch_ms(e.close_time) AS inputs
FROM ({_MTF}) e JOIN x_regime r ON r.instrument = e.instrument AND r.open_time = e.open_time
ASOF LEFT JOIN x_obi b ON b.instrument = e.instrument AND e.close_time >= b.ts
ASOF LEFT JOIN (SELECT instrument, ts, coalesce((open_interest - p) / p, 0) AS oi_change FROM (
  SELECT *, lag(open_interest) OVER (PARTITION BY instrument ORDER BY ts, event_id) AS p FROM x_oi)) o ON o.instrument = e.instrument AND e.close_time >= o.ts
ASOF LEFT JOIN x_feat f ON f.instrument = e.instrument AND e.close_time >= f.event_time
ASOF LEFT JOIN x_mood s ON s.instrument = e.instrument AND e.close_time >= s.mood_ts""")
def f16(spark, sf):
    return assembled(spark, sf).transform(
        pick, "instrument", "unix_micros(event_time) event_us", *[f"snap(values['{k}'], 5) v_{k}" for k in _VALUES], "array_join(input_event_ids, ',') inputs")


@query("f17_signal_counts", """
SELECT instrument, count(*) AS published, count(*) FILTER (WHERE abs(obi) > 0.7) AS signals,
  count(*) FILTER (WHERE obi > 0.7) AS sells, count(*) FILTER (WHERE obi < -0.7) AS buys FROM x_feat GROUP BY instrument""")
def f17(spark, sf):
    return signals.signal_counts(signals.signal_flags(views.features(spark, sf)))


@query("f18_lineage_edges", f"""
SELECT 'kline5m' AS input_type, 'kline5m:' || replace(instrument, '-', '') || ':' || epoch_ms(close_time) AS input_id FROM x_sig5 UNION ALL
SELECT 'orderbook', 'orderbook:' || replace(e.instrument, '-', '') || ':' || b.book_id
FROM x_sig5 e ASOF JOIN x_obi b ON b.instrument = e.instrument AND e.close_time >= b.ts""")
def f18(spark, sf):
    return signals.lineage_edges(assembled(spark, sf)).select("input_type", "input_id")


@query("f19_vpin", """
SELECT instrument, bucket, snap(abs(flow) / 200, 6) AS imbalance,
  snap(avg(abs(flow) / 200) OVER (PARTITION BY instrument ORDER BY bucket ROWS 49 PRECEDING), 6) AS vpin FROM x_vpin""")
def f19(spark, sf):
    return signals.vpin(views.trade_ticks(spark, sf), bucket_volume=200.0).transform(
        pick, "instrument", "bucket", "snap(imbalance, 6) imbalance", "snap(vpin, 6) vpin")


# --- point in time ----------------------------------------------------------------------------

_T = f"TIMESTAMP '{views.AS_OF_MID}'"


@query("p1_features_as_of", f"""
SELECT instrument, arg_max(event_id, (event_time, ingest_time, event_id)) AS event_id, snap(arg_max(obi, (event_time, ingest_time, event_id)), 6) AS obi
FROM x_rev WHERE event_time <= {_T} AND ingest_time <= {_T} GROUP BY instrument""")
def p1(spark, sf):
    return store.features_as_of(views.revisions(spark, sf), views.AS_OF_MID, take=["event_id", "obi"]).transform(pick, "instrument", "event_id", "snap(obi, 6) obi")


@query("p2_feature_history", """
SELECT event_id, epoch_us(ingest_time) AS ingest_us FROM x_rev WHERE instrument = 'ETH-USDT'
ORDER BY ingest_time DESC, event_time DESC, event_id DESC LIMIT 50""")
def p2(spark, sf):
    return store.feature_history(views.revisions(spark, sf), "ETH-USDT").transform(pick, "event_id", "unix_micros(ingest_time) ingest_us")


@query("p3_feature_sources", """
SELECT instrument, count(*) AS events, epoch_us(min(event_time)) AS first_us, epoch_us(max(event_time)) AS last_us,
  epoch_us(max(ingest_time)) AS ingest_us, snap(greatest(max(epoch_us(ingest_time) - epoch_us(event_time)) / 1e6, 0), 3) AS max_lag_secs
FROM x_rev GROUP BY instrument""")
def p3(spark, sf):
    return store.feature_sources(views.revisions(spark, sf)).transform(
        pick, "instrument", "events", "unix_micros(first_event) first_us", "unix_micros(last_event) last_us",
        "unix_micros(last_ingest) ingest_us", "snap(max_lag_secs, 3) max_lag_secs")


def pit(spark, sf):
    return store.pit_join(views.spine(spark, sf), views.revisions(spark, sf), take=["obi", "midPrice"])


@query("p4_pit_join", """
SELECT spine_id, arg_max(v.event_id, (v.event_time, v.ingest_time, v.event_id)) AS feature_id,
  snap(arg_max(v.obi, (v.event_time, v.ingest_time, v.event_id)), 6) AS obi
FROM x_spine s LEFT JOIN x_rev v ON v.instrument = s.instrument AND v.event_time <= s.decision_time AND v.ingest_time <= s.decision_time
GROUP BY spine_id""")
def p4(spark, sf):
    return pit(spark, sf).transform(pick, "spine_id", "feature_id", "snap(obi, 6) obi")


@query("p5_training_window", f"""
SELECT event_id, instrument FROM x_rev WHERE event_time <= {_T} AND ingest_time <= {_T}""")
def p5(spark, sf):
    return store.training_window(views.revisions(spark, sf), views.AS_OF_MID).select("event_id", "instrument")


@query("p6_lookahead_audit", """
SELECT spine_id FROM (
  SELECT spine_id, any_value(decision_time) AS t, arg_max(v.event_time, (v.event_time, v.ingest_time, v.event_id)) AS et,
    arg_max(v.ingest_time, (v.event_time, v.ingest_time, v.event_id)) AS it
  FROM x_spine s LEFT JOIN x_rev v ON v.instrument = s.instrument AND v.event_time <= s.decision_time AND v.ingest_time <= s.decision_time
  GROUP BY spine_id) WHERE spine_id % 7 = 0 AND greatest(et, it) > t - INTERVAL 20 MINUTE""")
def p6(spark, sf):
    """A join that lets every seventh row see 20 minutes ahead; the audit names those that did."""
    ahead = F.when(F.col("spine_id") % 7 == 0, F.expr("interval 20 minutes")).otherwise(F.expr("interval 0 minutes"))
    return store.lookahead_audit(pit(spark, sf).withColumn("decision_time", F.col("decision_time") - ahead)).select("spine_id")


@query("p6_no_lookahead", "SELECT spine_id FROM x_spine WHERE false")
def p6_none(spark, sf):
    return store.lookahead_audit(pit(spark, sf)).select("spine_id")


@query("p7_revisions", f"""
SELECT instrument, epoch_us(event_time) AS event_us, count(*) AS versions, arg_max(event_id, (ingest_time, event_id)) AS event_id,
  snap(arg_max(obi, (ingest_time, event_id)), 6) AS obi
FROM x_rev WHERE event_time <= {_T} AND ingest_time <= {_T} GROUP BY instrument, event_time""")
def p7(spark, sf):
    return store.revisions_as_of(views.revisions(spark, sf), views.AS_OF_MID, take=["event_id", "obi"]).transform(
        pick, "instrument", "unix_micros(event_time) event_us", "versions", "event_id", "snap(obi, 6) obi")


@query("io9_feature_store_append", """
SELECT id AS event_id, n, epoch_us(t) AS event_us FROM (
  SELECT CASE WHEN k < 5 THEN NULL ELSE event_id END AS id, count(*) * CASE WHEN k < 5 THEN 3 ELSE 1 END AS n, min(event_time) AS t
  FROM x_feat GROUP BY CASE WHEN k < 5 THEN NULL ELSE event_id END, k < 5)""")
def io9(spark, sf):
    """Three loads of the same events, the last with every time a day later: an id is stored
    once, as it first came, whatever its date; rows without one always."""
    import uuid

    from tapeworks.session import durable_dir
    f = views.features(spark, sf)
    f = f.withColumn("event_id", F.when(F.col("k") >= 5, F.col("event_id")))
    path = f"{durable_dir(spark)}/store-{uuid.uuid4().hex}"
    later = f.withColumn("event_time", F.col("event_time") + F.expr("interval 1 day"))
    for i, batch in enumerate((f, f, later)):
        store.append_indexed(batch, path, i)
    return spark.read.parquet(path).groupBy("event_id").agg(
        F.count("*").alias("n"), F.unix_micros(F.min("event_time")).alias("event_us"))


# --- decisions --------------------------------------------------------------------------------

def decided(spark, sf):
    return decisions.decide(views.features(spark, sf))


@query("x1_decide", "SELECT event_id, type, side, blocked_by, counted FROM x_dec")
def x1(spark, sf):
    return decided(spark, sf).select("event_id", "type", "side", "blocked_by", "counted")


@query("x2_explanations", r"""
SELECT event_id, type, CASE WHEN NOT counted THEN ''
  WHEN type = 'no_signal' THEN printf('Imbalance %+.4f stays within %.2f, no signal.', obi, eff)
  ELSE printf('%s signal: imbalance %+.4f beyond %.2f. ', side, obi, eff) || CASE blocked_by
    WHEN 'volume_spike' THEN printf('Blocked, volume is %.1f times normal.', volumeRatio)
    WHEN 'momentum' THEN printf('Blocked, momentum %+.4f runs against the trade.', momentum)
    WHEN 'sentiment' THEN printf('Blocked, fear and greed index at %.0f.', fearGreed)
    ELSE 'Taken at about ' || CAST(round(CAST(CAST(midPrice AS VARCHAR) AS DECIMAL(38, 15)), 2) AS DECIMAL(18, 2)) || printf(': momentum %+.4f, volatility %.4f, fear and greed %.0f.', momentum, volatility, fearGreed) END
  END AS explanation FROM x_dec""")
def x2(spark, sf):
    return decisions.explain_decisions(decided(spark, sf)).select("event_id", "type", "explanation")


@query("x3_decision_stats", """
SELECT *, snap(blocked_total / greatest(would_have_traded, 1), 6) AS block_rate FROM (
  SELECT count(*) FILTER (WHERE counted) AS total, count(*) FILTER (WHERE type = 'no_signal' AND counted) AS no_signal,
    count(*) FILTER (WHERE type = 'trade') AS traded, count(*) FILTER (WHERE blocked_by = 'volume_spike') AS blocked_volume,
    count(*) FILTER (WHERE blocked_by = 'momentum') AS blocked_momentum, count(*) FILTER (WHERE blocked_by = 'sentiment') AS blocked_sentiment,
    count(blocked_by) AS blocked_total, count(side) AS would_have_traded FROM x_dec)""")
def x3(spark, sf):
    return decisions.decision_stats(decided(spark, sf)).transform(
        pick, "total", "no_signal", "traded", "blocked_volume", "blocked_momentum", "blocked_sentiment", "blocked_total",
        "would_have_traded", "snap(block_rate, 6) block_rate")


@query("x4_recent_decisions", """
SELECT event_id, blocked_by FROM x_dec WHERE type = 'blocked' ORDER BY event_time DESC, event_id DESC LIMIT 50""")
def x4(spark, sf):
    return decisions.recent_decisions(decided(spark, sf), kind="blocked").select("event_id", "blocked_by")


@query("x5_decision_to_fill", """
SELECT d.event_id, CASE WHEN f.ts <= d.event_time + INTERVAL 1 HOUR THEN f.execution_id END AS fill_id
FROM x_dec d ASOF LEFT JOIN (SELECT *, ts - INTERVAL 30 MINUTE AS lagged FROM x_fills) f
  ON f.instrument = d.instrument AND d.event_time <= f.ts WHERE d.type = 'trade'""")
def x5(spark, sf):
    return decisions.next_fill(decided(spark, sf), views.fills(spark, sf), tolerance="1 hour").select("event_id", "fill_id")


# --- execution cost ---------------------------------------------------------------------------

@query("t1_arrival_join", "SELECT execution_id, snap(arrival, 6) AS arrival FROM x_arrival")
def t1(spark, sf):
    return tca.arrival_join(views.fills(spark, sf), views.ticks(spark, sf)).transform(pick, "execution_id", "snap(arrival, 6) arrival")


@query("t2_tca_per_fill", """
SELECT execution_id, snap(fee_bps, 6) AS fee_bps, snap(slip, 4) AS slippage, source AS slippage_source, snap(slip_cost, 5) AS slippage_cost,
  snap(shortfall, 5) AS shortfall FROM x_tca""")
def t2(spark, sf):
    return tca_fills(spark, sf).transform(
        pick, "execution_id", "snap(fee_bps, 6) fee_bps", "snap(slippage, 4) slippage", "slippage_source",
        "snap(slippage_cost, 5) slippage_cost", "snap(shortfall, 5) shortfall")


@query("t3_t4_tca_summary", """
SELECT coalesce(instrument, 'all') AS level, count(*) AS fills, snap(sum(transaction_cost), 4) AS fees, snap(sum(notional), 3) AS notional,
  snap(sum(fee_bps * notional) / sum(notional), 6) AS avg_fee_bps, snap(avg(slip), 5) AS avg_slippage_bps, count(slip) AS slippage_defined,
  count(*) FILTER (WHERE liquidity = 'maker') AS makers, count(*) FILTER (WHERE liquidity = 'taker') AS takers,
  snap(count(*) FILTER (WHERE liquidity = 'maker') / count(*) FILTER (WHERE liquidity = 'taker'), 6) AS maker_taker_ratio,
  snap(sum(shortfall), 4) AS shortfall, CASE WHEN bool_or(source = 'arrival') THEN 'arrival' ELSE 'reported' END AS basis,
  epoch_us(max(ts)) AS as_of_us FROM x_tca GROUP BY ROLLUP (instrument)""")
def t3(spark, sf):
    return tca.tca_summary(tca_fills(spark, sf)).transform(
        pick, "level", "fills", "snap(fees, 4) fees", "snap(notional, 3) notional", "snap(avg_fee_bps, 6) avg_fee_bps",
        "snap(avg_slippage_bps, 5) avg_slippage_bps", "slippage_defined", "makers", "takers",
        "snap(maker_taker_ratio, 6) maker_taker_ratio", "snap(shortfall, 4) shortfall", "basis", "unix_micros(as_of) as_of_us")


@query("t5_recent_fills", "SELECT execution_id, snap(shortfall, 5) AS shortfall FROM x_tca ORDER BY ts DESC, execution_id DESC LIMIT 50")
def t5(spark, sf):
    from tapeworks.operators.ledger import recent
    return recent(tca_fills(spark, sf), 50, time="ts").transform(pick, "execution_id", "snap(shortfall, 5) shortfall")


@query("t6_t7_estimates", "SELECT instrument, fills, snap(sigma, 8) AS sigma, snap(adv, 3) AS adv, snap(trade_notional, 5) AS trade_notional FROM x_est")
def t67(spark, sf):
    return estimates(spark, sf).transform(
        pick, "instrument", "fills", "snap(sigma, 8) sigma", "snap(adv, 3) adv", "snap(trade_notional, 5) trade_notional")


@query("t8_impact", """
SELECT order_id, snap(notional / adv, 8) AS participation, snap(sigma * sqrt(notional / adv) * 1e4, 4) AS temporary_bps,
  snap(0.1 * sigma * (notional / adv) * 1e4, 4) AS permanent_bps FROM x_orders JOIN x_est USING (instrument)""")
def t8(spark, sf):
    return tca.impact(views.order_book_orders(spark, sf), estimates(spark, sf)).transform(
        pick, "order_id", "snap(participation, 8) participation", "snap(temporary_bps, 4) temporary_bps", "snap(permanent_bps, 4) permanent_bps")


_SCHEDULE = """
SELECT order_id, notional, slices, slice, acosh(1 + sigma * sigma / 0.0095::DOUBLE / 2) AS kap FROM (
  SELECT *, unnest(range(1, slices + 1)) AS slice FROM x_orders JOIN x_est USING (instrument))"""


@query("t9_execution_schedule", f"""
SELECT order_id, CAST(slice AS INTEGER) AS slice, snap(notional * (sinh(kap * (slices - slice + 1)) - sinh(kap * (slices - slice))) / sinh(kap * slices), 4) AS child,
  snap(notional * (1 - sinh(kap * (slices - slice)) / sinh(kap * slices)), 4) AS cumulative FROM ({_SCHEDULE})""")
def t9(spark, sf):
    return tca.execution_schedule(views.order_book_orders(spark, sf), estimates(spark, sf)).transform(
        pick, "order_id", "slice", "snap(child, 4) child", "snap(cumulative, 4) cumulative")


@query("t10_twap_vwap_slices", """
SELECT order_id, CAST(slice AS INTEGER) AS slice, snap(notional / slices, 5) AS twap,
  snap(notional * w / sum(w) OVER (PARTITION BY order_id), 5) AS vwap FROM (
  SELECT *, 1 + ((2 * slice - 1 - slices) / slices) ** 2 AS w FROM (SELECT *, unnest(range(1, slices + 1)) AS slice FROM x_orders))""")
def t10(spark, sf):
    o = views.order_book_orders(spark, sf)
    even = tca.twap_slices(o).select("order_id", "slice", F.col("child").alias("twap"))
    shaped = tca.vwap_slices(o).select("order_id", "slice", F.col("child").alias("vwap"))
    return even.join(shaped, ["order_id", "slice"]).transform(pick, "order_id", "slice", "snap(twap, 5) twap", "snap(vwap, 5) vwap")


@query("t11_capacity", """
SELECT instrument, snap(u * u * adv, 3) AS capacity, snap(u * u, 8) AS participation, snap(10, 5) AS impact_bps FROM (
  SELECT *, (sqrt(a * a + 4 * b * 10) - a) / (2 * b) AS u FROM (SELECT *, sigma * 1e4 AS a, 0.1 * sigma * 1e4 AS b FROM x_est))""")
def t11(spark, sf):
    return tca.capacity(estimates(spark, sf)).transform(
        pick, "instrument", "snap(capacity, 3) capacity", "snap(participation, 8) participation", "snap(impact_bps, 5) impact_bps")


@query("t12_impact_curve", """
SELECT instrument, CAST(step AS INTEGER) AS step, snap(f * u * u * adv, 3) AS size, snap(a * sqrt(f * u * u) + b * f * u * u, 5) AS impact_bps FROM (
  SELECT *, 0.05 + 1.95 * step / 12 AS f, (sqrt(a * a + 4 * b * 10) - a) / (2 * b) AS u FROM (
    SELECT *, sigma * 1e4 AS a, 0.1 * sigma * 1e4 AS b, unnest(range(13)) AS step FROM x_est))""")
def t12(spark, sf):
    return tca.impact_curve(tca.capacity(estimates(spark, sf))).transform(
        pick, "instrument", "step", "snap(size, 3) size", "snap(impact_bps, 5) impact_bps")


@query("t13_cost_hurdle", """
SELECT instrument, count(*) FILTER (WHERE 60 * abs(obi) > 28) AS taken, count(*) FILTER (WHERE NOT 60 * abs(obi) > 28) AS suppressed
FROM x_feat GROUP BY instrument""")
def t13(spark, sf):
    return tca.hurdle_gate(views.features(spark, sf), multiple=2.0).groupBy("instrument").agg(
        F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("suppressed"))

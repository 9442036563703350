"""Fill accounting: known small cases and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from tapeworks.functions.scan import order_cuts
from tapeworks.operators import ledger, quality, risk


def fills_of(spark, rows):
    """rows: (side, qty, price, fee, slippage_bps)"""
    data = [(f"x{i:03d}", "A", s, float(q), float(p), float(f), float(b), i) for i, (s, q, p, f, b) in enumerate(rows)]
    return spark.createDataFrame(
        data, "execution_id string, instrument string, side string, quantity double, fill_price double, "
              "transaction_cost double, slippage_bps double, t long").withColumn("ts", F.timestamp_seconds("t"))


@pytest.mark.parametrize("rows, pnl, label", [
    ([("BUY", 1, 100, .10, 0), ("SELL", 1, 110, .11, 0)], 9.79, 1),
    ([("BUY", 1, 100, .10, 0), ("SELL", 1, 99, .10, 0)], -1.20, 0),
    ([("BUY", 2, 100, .20, 0), ("SELL", 1, 110, .05, 0), ("SELL", 1, 110, .05, 0)], 19.70, 1),
    ([("SELL", 1, 100, .10, 0), ("BUY", 1, 90, .10, 0)], 9.80, 1),
])
def test_fifo_labels(spark, rows, pnl, label):
    out = ledger.fifo_labels(ledger.fifo_match(fills_of(spark, rows))).collect()
    assert len(out) == 1
    assert out[0].pnl == pytest.approx(pnl) and out[0].label == label


def test_fifo_partial_close_is_not_labelled(spark):
    m = ledger.fifo_match(fills_of(spark, [("BUY", 2, 100, .2, 0), ("SELL", 1, 110, .05, 0)]))
    assert m.count() == 1 and ledger.fifo_labels(m).count() == 0


def test_flip_opens_the_leftover(spark):
    rows = [("BUY", 1, 100, 0, 0), ("SELL", 3, 110, 0, 0), ("BUY", 2, 105, 0, 0)]
    f = fills_of(spark, rows)
    got = {r.entry_id: r for r in ledger.fifo_labels(ledger.fifo_match(f)).collect()}
    assert got["x000"].pnl == pytest.approx(10) and got["x001"].pnl == pytest.approx(10)
    pos = ledger.signed_positions(f).orderBy("ts").collect()
    assert [p.qty for p in pos] == [1, -2, 0]
    assert [p.avg_cost for p in pos] == [100, 110, 0]


def test_round_trip_slippage(spark):
    t = ledger.round_trips(ledger.signed_positions(fills_of(
        spark, [("BUY", 1, 100, 0, 50), ("SELL", 1, 110, .1, 50)]))).first()
    assert t.slippage == pytest.approx(1.05) and t.fee == pytest.approx(.1) and t.net_pnl == pytest.approx(9.9)


def test_equity_equals_cash_when_flat_and_fair_buy_is_neutral(spark):
    f = fills_of(spark, [("BUY", 2, 100, 0, 0), ("SELL", 2, 90, 0, 0), ("SELL", 1, 50, 0, 0), ("BUY", 1, 40, 0, 0)])
    e = ledger.equity_curve(ledger.signed_positions(f)).orderBy("ts").collect()
    assert e[0].value == pytest.approx(1000)  # buying at a fair price changes nothing
    assert e[1].value == pytest.approx(e[1].cash) == pytest.approx(980)
    assert e[3].value == pytest.approx(990)


def test_drawdown_duration(spark):
    f = fills_of(spark, [("BUY", 1, 100, 0, 0), ("SELL", 1, 90, 0, 0), ("BUY", 1, 90, 0, 0), ("SELL", 1, 130, 0, 0)])
    p = ledger.drawdown_points(ledger.equity_curve(ledger.signed_positions(f)))
    s = ledger.drawdown_summary(p, as_of="1970-01-01 00:01:00").first()
    assert s.max_drawdown == pytest.approx(10) and s.max_drawdown_pct == pytest.approx(.01)
    assert s.max_dd_duration_secs == 2 and s.current_dd_duration_secs == 0


def test_long_decay_does_not_underflow(spark):
    """Thousands of partial closes and adds: the running product leaves the range of exp()."""
    rows, q = [], 0.0
    for i in range(1200):
        if i % 2 == 0:
            rows.append(("BUY", 64, 100 + i % 7, 0, 1))
            q += 64
        else:
            rows.append(("SELL", q * 0.75, 101 + i % 5, 0, 1))
            q *= 0.25
    f = fills_of(spark, rows)
    got = ledger.signed_positions(f, cuts=order_cuts(f, ["ts", "execution_id"], blocks=5)).orderBy("ts").collect()
    q = avg = 0.0
    for (side, n, px, _, _), g in zip(rows, got):
        if side == "BUY":
            avg = (avg * q + px * n) / (q + n)
            q += n
        else:
            q -= n
        assert g.avg_cost == pytest.approx(avg, rel=1e-9)


def test_ledger_does_not_depend_on_blocks_or_partitions(spark):
    rows = [("BUY" if i * 7 % 5 < 3 else "SELL", 1 + i % 4, 100 + i % 11, .01, i % 3) for i in range(300)]
    f = fills_of(spark, rows)
    order = ["ts", "execution_id"]
    base = None
    for df, blocks in ((f, 1), (f.repartition(64), 9), (f.orderBy(F.rand(1)), 40)):
        out = ledger.signed_positions(df, cuts=order_cuts(df, order, blocks=blocks))
        got = [(r.execution_id, r.qty, round(r.avg_cost, 8), round(r.open_slippage, 8)) for r in out.orderBy(*order).collect()]
        base = base or got
        assert got == base


def trips_of(spark, nets, pnl=None):
    rows = [("A", f"x{i}", float(p if pnl is None else pnl[i]), 0.0, 0.0, float(p)) for i, p in enumerate(nets)]
    return spark.createDataFrame(rows, "instrument string, execution_id string, pnl double, fee double, slippage double, net_pnl double")


@pytest.mark.parametrize("nets, factor", [([10, 20, -10], 3.0), ([10, 5], None), ([0], 0.0)])
def test_profit_factor(spark, nets, factor):
    assert risk.trade_stats(trips_of(spark, nets)).first().profit_factor == factor


@pytest.mark.parametrize("nets, rate", [([10, -10], .5), ([30, -10], .25)])
def test_break_even_win_rate(spark, nets, rate):
    assert risk.cost_attribution(trips_of(spark, nets)).first().break_even_winrate == pytest.approx(rate)


def test_cost_efficiency(spark):
    t = trips_of(spark, [10]).withColumns({"fee": F.lit(4.0), "slippage": F.lit(1.0)})
    assert risk.cost_attribution(t).first().cost_efficiency == pytest.approx(2.0)


def test_cvar_and_kelly_need_enough_trades(spark):
    assert risk.cvar(trips_of(spark, [1, 2, 3])).first().cvar == 0
    assert risk.cvar(trips_of(spark, [-5, 1, 2, 3, 4, 5])).first().cvar == -5
    assert risk.trade_stats(trips_of(spark, [1, -1])).first().half_kelly == 0


def test_bootstrap_brackets_the_sharpe_ratio(spark):
    nets = [math.sin(i * 12.9898) * 3 + .5 for i in range(400)]
    t = trips_of(spark, nets)
    b = risk.bootstrap_sharpe(t, id_hash=F.xxhash64("execution_id"), n_sims=1000).first()
    mean = sum(nets) / len(nets)
    sd = (sum((x - mean) ** 2 for x in nets) / len(nets)) ** .5
    assert b.sharpe == pytest.approx(mean / sd)
    assert b.ci_low < b.sharpe < b.ci_high
    # the interval's half-width is about two standard errors
    assert (b.ci_high - b.ci_low) / 2 == pytest.approx(1.96 / 20, rel=.15)


def test_reconciliation_without_fills_is_quiet(spark):
    pos = ledger.signed_positions(fills_of(spark, [("BUY", 1, 1, 0, 0)])).where("false")
    r = risk.reconciliation(pos).first()
    assert r.diverged is False and r.verdict == "no fills yet"


def test_replaying_fills_changes_nothing(spark):
    raw = spark.createDataFrame(
        [("x1", "o1", "A", "BUY", "1", "100", None, None, None, "2024-01-01T00:00:00Z", 1),
         (" ", "o2", "A", "SELL", "1", "101", "0.1", None, None, "2024-01-01T00:01:00Z", 2),
         ("x3", "o3", "A", "SELL", "nope", "101", "0.1", None, None, "2024-01-01T00:01:00Z", 3)],
        "execution_id string, order_id string, instrument string, side string, quantity string, fill_price string, "
        "transaction_cost string, slippage_bps string, liquidity string, timestamp string, arrival_no long")
    v = quality.validate_fills(raw.unionByName(raw))
    assert {r.reason: r.n for r in quality.reject_counts(v).collect()} == {"processed": 4, "non_numeric": 2}
    out = quality.dedup_fills(quality.typed_fills(v), order=["arrival_no"]).collect()
    assert len(out) == 2 and all(r.transaction_cost is not None for r in out)

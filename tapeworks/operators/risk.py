"""Performance and risk figures over round trips and the equity curve."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numeric import clamp, ratio
from tapeworks.functions.scan import Cuts, running
from tapeworks.session import materialize

YEAR_HOURS = 8760.0
ZERO_STD = 0.001
SHARPE_HOURS = (1, 6, 24)
MIN_RETURNS = 5
Z_95, Z_99 = 1.645, 2.326


def change_series(equity: DataFrame) -> DataFrame:
    """Per-fill change of realized profit minus fees; the very first fill has none."""
    return equity.where(F.col("fills") > 1)


def _age_hours(time: str, as_of) -> Column:
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(time)) / 3.6e9


def rolling_ratios(equity: DataFrame, *, as_of, hours=SHARPE_HOURS, time="ts") -> DataFrame:
    """Sharpe and Sortino ratios for each look-back in hours, all in one pass; nothing after as_of counts."""
    changes = change_series(equity).withColumn("__age", _age_hours(time, as_of)).where(F.col("__age") >= 0)
    # a row counts in every look-back that covers it
    covered = F.array_compact(F.array(*[F.when(F.col("__age") <= h, F.lit(h)) for h in hours]))
    per = changes.select("change", F.explode(covered).alias("hours")).groupBy("hours").agg(
        F.count("*").alias("n"), F.avg("change").alias("mean"), F.stddev_pop("change").alias("std"),
        F.sum(F.when(F.col("change") < 0, F.col("change") ** 2).otherwise(0.0)).alias("down"),
    )
    spark = equity.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(h) for h in hours])).alias("hours"))
    m = grid.join(per, "hours", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    scale = F.sqrt(F.col("n") / F.greatest(F.col("hours"), F.lit(1)) * YEAR_HOURS)
    std = F.when(F.col("std") > 0, F.col("std")).otherwise(ZERO_STD)
    down_dev = F.sqrt(F.col("down") / F.nullif(F.col("n"), F.lit(0)))
    sortino = (
        F.when(F.col("n") < 2, 0.0)
        .when(F.col("down") > 0, F.col("mean") / F.nullif(down_dev, F.lit(0.0)) * scale)
        .when(F.col("mean") > 0, 99.0)
        .otherwise(0.0)
    )
    return m.select(
        "hours", "n", F.when(F.col("n") < 2, 0.0).otherwise(F.col("mean") / std * scale).alias("sharpe"),
        sortino.alias("sortino"),
    )


def cvar(trips: DataFrame, *, percent: float = 5, uid: str = "execution_id") -> DataFrame:
    """Mean of the worst `percent` of net profits; 0 below five trades.

    The worst k rows are found by a distributed rank, so k may be any size.
    """
    ranked = running(trips.select("net_pnl", uid), {"__n": ("count", F.lit(1))}, order=["net_pnl", uid])
    total = trips.count()
    k = max(1, int(total * percent / 100))
    tail = F.avg(F.when(F.col("__n") <= k, F.col("net_pnl")))
    return ranked.agg(
        F.count("*").alias("n"),
        F.when(F.count("*") < MIN_RETURNS, 0.0).otherwise(tail).alias("cvar"),
    )


def _win() -> Column:
    return F.col("net_pnl") > 0


def _loss() -> Column:
    return F.col("net_pnl") < 0


def _trip_aggregates() -> list[Column]:
    net = F.col("net_pnl")
    return [
        F.count("*").alias("round_trips"),
        F.count_if(_win()).alias("wins"),
        F.count_if(_loss()).alias("losses"),
        F.coalesce(F.sum(F.when(_win(), net)), F.lit(0.0)).alias("gross_profit"),
        F.abs(F.coalesce(F.sum(F.when(_loss(), net)), F.lit(0.0))).alias("gross_loss"),
    ]


def _profit_factor() -> Column:
    return F.when(F.col("gross_loss") > 0, ratio(F.col("gross_profit"), F.col("gross_loss"))).when(
        F.col("gross_profit") <= 0, 0.0
    )


def trade_stats(trips: DataFrame) -> DataFrame:
    """Win rate over decisive trades, profit factor, average win and loss, half-Kelly."""
    a = trips.agg(*_trip_aggregates()).withColumn("decisive", F.col("wins") + F.col("losses"))
    a = a.withColumns({
        "win_rate": F.coalesce(ratio(F.col("wins"), F.col("decisive")), F.lit(0.0)),
        "profit_factor": _profit_factor(),
        "avg_win": F.coalesce(ratio(F.col("gross_profit"), F.col("wins")), F.lit(0.0)),
        "avg_loss": F.coalesce(ratio(F.col("gross_loss"), F.col("losses")), F.lit(0.0)),
    })
    b = ratio(F.col("avg_win"), F.col("avg_loss"))
    kelly = clamp(ratio(b * F.col("win_rate") - (1 - F.col("win_rate")), b) / 2, 0.0, 0.25)
    enough = (F.col("round_trips") >= 10) & (F.col("wins") > 0) & (F.col("losses") > 0)
    return a.withColumn("half_kelly", F.when(enough, F.coalesce(kelly, F.lit(0.0))).otherwise(0.0)).drop("decisive")


def calmar(equity: DataFrame, drawdown: DataFrame, *, as_of, initial_cash: float, time="ts",
           uid="execution_id") -> DataFrame:
    """Annualized return over the worst drawdown share, from what happened up to as_of."""
    e = equity.where(F.col(time) <= F.lit(as_of).cast("timestamp")).agg(
        F.min(time).alias("start"), F.count("*").alias("points"),
        F.max_by("value", F.struct(time, uid)).alias("last_value"), F.lit(1).alias("one"),
    )
    d = drawdown.select("max_drawdown_pct", F.lit(1).alias("one"))
    micros = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("start")
    years = F.greatest(micros / 1e6 / (365.25 * 86400), F.lit(0.001))
    annual = (F.col("last_value") - initial_cash) / initial_cash / years
    ok = (F.col("max_drawdown_pct") > 0) & (F.col("points") >= 2)
    return e.join(d, "one").select(
        "last_value", F.when(ok, ratio(annual, F.col("max_drawdown_pct"))).otherwise(0.0).alias("calmar")
    )


def performance_summary(positions: DataFrame) -> DataFrame:
    """One row: realized profit, fees, net, fee drag and the trade statistics."""
    trips = positions.withColumn("net_pnl", F.when(F.col("opposes"), F.col("realized") - F.col("transaction_cost")))
    net = F.col("net_pnl")
    a = trips.agg(
        F.count("*").alias("total_fills"),
        F.count(net).alias("round_trips"),
        F.sum("realized").alias("realized_pnl"),
        F.sum("transaction_cost").alias("total_fees"),
        F.sum("fill_slippage").alias("total_slippage"),
        F.count_if(_win()).alias("wins"), F.count_if(_loss()).alias("losses"),
        F.coalesce(F.sum(F.when(_win(), net)), F.lit(0.0)).alias("gross_profit"),
        F.abs(F.coalesce(F.sum(F.when(_loss(), net)), F.lit(0.0))).alias("gross_loss"),
    )
    fees, realized = F.col("total_fees"), F.col("realized_pnl")
    return a.select(
        "total_fills", "round_trips", "realized_pnl", "total_fees", "total_slippage",
        (realized - fees).alias("net_trading_pnl"),
        (fees / F.greatest(F.abs(realized), F.lit(0.01)) * 100).alias("fee_drag_pct"),
        F.coalesce(ratio(F.col("wins"), F.col("wins") + F.col("losses")), F.lit(0.0)).alias("win_rate"),
        _profit_factor().alias("profit_factor"),
        F.coalesce(ratio(F.col("gross_profit"), F.col("wins")), F.lit(0.0)).alias("avg_win"),
        F.coalesce(ratio(F.col("gross_loss"), F.col("losses")), F.lit(0.0)).alias("avg_loss"),
    )


def by_instrument(positions: DataFrame, *, time="ts", uid="execution_id") -> DataFrame:
    """Trades, round trips, win rate over all trips, net profit and latest position, in one pass."""
    net = F.when(F.col("opposes"), F.col("realized") - F.col("transaction_cost"))
    return positions.groupBy("instrument").agg(
        F.count("*").alias("trades"),
        F.count(net).alias("round_trips"),
        F.coalesce(ratio(F.count_if(net > 0), F.count(net)), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.sum(net), F.lit(0.0)).alias("net_pnl"),
        F.max_by(F.struct("qty", "avg_cost"), F.struct(time, uid)).alias("p"),
    ).select(
        "instrument", "trades", "round_trips", "win_rate", "net_pnl",
        F.col("p.qty").alias("position"), F.col("p.avg_cost").alias("avg_cost"),
    )


def ranked_returns(trips: DataFrame, *, last_n: int | None = None, time="time",
                   uid="execution_id", cuts: Cuts | None = None) -> DataFrame:
    """Each instrument's returns numbered from the newest; the newest last_n only if the caller says so."""
    r = running(
        trips.select("instrument", F.col("net_pnl").alias("ret"), time, uid),
        {"pos": ("count", F.lit(1))}, key=["instrument"], order=[time, uid], descending=True, cuts=cuts,
    )
    return r.where(F.col("pos") <= last_n) if last_n else r


_CHUNK = 256
PAIR_BLOCK = 256
_PAIR = "a string, b string, n long, sa double, sb double, saa double, sbb double, sab double"


def _pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    wide = pdf.pivot(index="pos", columns="instrument", values="ret")
    names = wide.columns.to_numpy()
    have = wide.notna().to_numpy().astype(float)
    x = np.nan_to_num(wide.to_numpy(dtype=float))
    block = pdf.drop_duplicates("instrument").set_index("instrument")["block"].reindex(names).to_numpy()
    i, j = np.triu_indices(len(names), 1)
    # a tile of two blocks makes the pairs between them, a tile of one those inside
    own = (block[i] != block[j]) | (pdf["bi"].iloc[0] == pdf["bj"].iloc[0])
    i, j = i[own], j[own]
    n, s, ss, xy = have.T @ have, x.T @ have, (x * x).T @ have, x.T @ x
    out = pd.DataFrame({
        "a": names[i], "b": names[j], "n": n[i, j].astype("int64"), "sa": s[i, j], "sb": s[j, i],
        "saa": ss[i, j], "sbb": ss[j, i], "sab": xy[i, j],
    })
    return out[out["n"] > 0]


def pair_correlations(ranked: DataFrame, *, floor: float = ZERO_STD, block: int = PAIR_BLOCK) -> DataFrame:
    """Population correlation of every instrument pair, aligned from the newest return back.

    Instruments are dealt into blocks of about `block`; a task multiplies one slice of the
    aligned series for two blocks as matrices. It sends one row per pair of its tile, and never
    one row per pair and time.
    """
    count = ranked.select("instrument").distinct().count()
    blocks = max(1, -(-count // block))
    own = F.pmod(F.xxhash64("instrument"), F.lit(blocks)).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(
        F.least("block", k).alias("bi"), F.greatest("block", k).alias("bj")))
    sliced = ranked.select("instrument", "pos", "ret", F.floor(F.col("pos") / _CHUNK).alias("slice"), own.alias("block"))
    sliced = sliced.withColumn("t", F.explode(tiles)).select("instrument", "pos", "ret", "slice", "block", "t.bi", "t.bj")
    sums = sliced.groupBy("slice", "bi", "bj").applyInPandas(lambda pdf: _pair_sums(pdf), _PAIR)
    t = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    n = F.col("n")

    def std(s, ss):
        return F.sqrt(F.greatest(F.col(ss) / n - (F.col(s) / n) ** 2, F.lit(0.0)))

    cov = F.col("sab") / n - F.col("sa") / n * F.col("sb") / n
    sd = [F.when(std(s, q) > 0, std(s, q)).otherwise(floor) for s, q in (("sa", "saa"), ("sb", "sbb"))]
    return t.where(n >= MIN_RETURNS).select("a", "b", "n", clamp(cov / (sd[0] * sd[1]), -1.0, 1.0).alias("corr"))


def portfolio_var(ranked: DataFrame) -> DataFrame:
    """Equal-weight variance-covariance value at risk with its diversification benefit."""
    sd = F.when(F.count("*") >= MIN_RETURNS, F.stddev_pop("ret")).otherwise(0.0)
    stds = ranked.groupBy("instrument").agg(sd.alias("std"))
    pairs = pair_correlations(ranked, floor=1e-10)
    cross = (
        pairs.join(stds.select(F.col("instrument").alias("a"), F.col("std").alias("std_a")), "a")
        .join(stds.select(F.col("instrument").alias("b"), F.col("std").alias("std_b")), "b")
        .agg(F.sum(F.col("std_a") * F.col("std_b") * F.col("corr")).alias("cross"), F.lit(1).alias("one"))
    )
    own = stds.agg(
        F.count("*").alias("instruments"), F.sum(F.col("std") ** 2).alias("own"),
        F.sum("std").alias("total"), F.lit(1).alias("one"),
    )
    n = F.col("instruments")
    sigma = F.sqrt(F.greatest(
        (F.col("own") + 2 * F.coalesce("cross", F.lit(0.0))) / (n * n), F.lit(0.0)
    ))
    return own.join(cross, "one").select(
        "instruments", (sigma * Z_95 * 100).alias("var_95"), (sigma * Z_99 * 100).alias("var_99"),
        F.coalesce((1 - ratio(sigma, F.col("total") / n)) * 100, F.lit(0.0)).alias("diversification_benefit"),
    )


_EPS = 1e-9


PORTFOLIO = ("instrument string, weight double, risk_contribution double, market double, momentum double, volatility double, n long, as_of timestamp, "
             "available boolean, reason string")


def portfolio_construction(ranked: DataFrame, *, time="time") -> DataFrame:
    """Inverse-volatility, demeaned, gross-one weights with factor exposures.

    Where there are none, one row says why: fewer than two instruments with enough returns, or
    volatilities that do not differ. The returns are read twice, for counts and for the common
    tail; all else works on one written row per instrument.
    """
    spark = ranked.sparkSession

    def unavailable(reason: str) -> DataFrame:
        return spark.createDataFrame([(*[None] * 8, False, reason)], PORTFOLIO)

    counts = ranked.groupBy("instrument").agg(F.count("*").alias("m"), F.max(time).alias("t")).where(F.col("m") >= MIN_RETURNS)
    counts = materialize(counts, "portfolio-counts")
    head = counts.agg(F.min("m").alias("n"), F.count("*").alias("k"), F.max("t").alias("as_of")).first()
    if head["k"] < 2:
        return unavailable(f"need at least 2 instruments with {MIN_RETURNS} returns, have {head['k']}")
    tails = ranked.where(F.col("pos") <= head["n"]).join(counts.select("instrument"), "instrument", "left_semi").select("instrument", "pos", "ret")
    basket = F.avg("ret").over(Window.partitionBy("pos"))  # a place holds one return of each instrument
    per = tails.withColumn("basket", basket).groupBy("instrument").agg(
        F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("vol"),
        F.covar_pop("ret", "basket").alias("cov"), F.stddev_pop("basket").alias("basket_std"))
    per = materialize(per.withColumn("raw", 1 / F.greatest("vol", F.lit(_EPS))), "portfolio")
    mid = per.agg(F.avg("raw").alias("mid")).first()["mid"]
    signed = F.col("raw") - F.lit(mid)
    usable_corr = (F.col("vol") > _EPS) & (F.col("basket_std") > _EPS)
    corr = F.when(usable_corr, clamp(ratio(F.col("cov"), F.col("vol") * F.col("basket_std")), -1.0, 1.0))
    sums = per.agg(
        F.sum(F.abs(signed)).alias("gross"), F.sum(F.abs(signed) * F.col("vol")).alias("load"), F.avg(corr).alias("market"),
        F.avg("mean").alias("momentum"), F.avg("vol").alias("volatility")).first()
    if not sums["gross"] > _EPS:
        return unavailable("the volatilities of the instruments do not differ")
    gross, load = F.lit(sums["gross"]), F.abs(signed) * F.col("vol")
    total = sums["load"] / sums["gross"]
    return per.select(
        "instrument", (signed / gross).alias("weight"),
        (load / gross / total if total > _EPS else F.lit(0.0)).alias("risk_contribution"),
        F.lit(sums["market"] or 0.0).alias("market"), F.lit(sums["momentum"]).alias("momentum"), F.lit(sums["volatility"]).alias("volatility"),
        F.lit(head["n"]).cast("long").alias("n"), F.lit(head["as_of"]).cast("timestamp").alias("as_of"), F.lit(True).alias("available"), F.lit(None).cast("string").alias("reason"))


SIMULATIONS = 5000
PRIME = 2**31 - 1
# Poisson(1) distribution function, as thresholds on a uniform integer below PRIME, until it
# can't be told from 1
POISSON_STEPS = [s for s in (int(c * PRIME) for c in np.cumsum([np.exp(-1.0) / factorial(k) for k in range(20)])) if s < PRIME - 1]


def _uniform(h: np.ndarray, s: np.ndarray) -> np.ndarray:
    x = (h * 48271 + s * 69621 + 12345) % PRIME
    x = x * x % PRIME
    x = (x * 48271 + s) % PRIME
    return x * x % PRIME


_SHIFT = 15
_UNSURE = 255
_EDGES = np.arange(0, PRIME + 1, 1 << _SHIFT)
#: The weight of all draws with the same upper bits, or that a threshold lies between such draws.
_WEIGHTS = np.searchsorted(POISSON_STEPS, _EDGES, side="right").astype(np.uint8)
_WEIGHTS[np.searchsorted(POISSON_STEPS, _EDGES + (1 << _SHIFT) - 1, side="right") != _WEIGHTS] = _UNSURE


def _below_prime(x: np.ndarray) -> np.ndarray:
    """x % PRIME in place, for x below PRIME squared: 2**31 is 1 there, so the upper bits are added."""
    upper = x >> np.uint64(31)
    x &= np.uint64(PRIME)
    x += upper
    return np.minimum(x, np.subtract(x, np.uint64(PRIME), out=upper), out=x)


def poisson_weights(h: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of whole numbers h from 0 below PRIME in simulations s, a row per h."""
    s = s.astype(np.uint64)[None, :]
    x = _below_prime((h.astype(np.uint64) * np.uint64(48271) % np.uint64(PRIME))[:, None] + s * np.uint64(69621) + np.uint64(12345))
    x *= x
    x = _below_prime(x)
    x *= np.uint64(48271)
    x += s
    x = _below_prime(x)
    x *= x
    x = _below_prime(x)
    u = x.view(np.int64)
    w = _WEIGHTS[u >> _SHIFT]
    rest = np.flatnonzero(w == _UNSURE)
    w.reshape(-1)[rest] = np.searchsorted(POISSON_STEPS, u.reshape(-1)[rest], side="right")
    return w


def bootstrap_moments(trips: DataFrame, *, id_hash: Column, n_sims: int = SIMULATIONS) -> DataFrame:
    """Resampled count, sum and sum of squares of net profit for every simulation.

    Resampling with replacement is a Poisson(1) weight per (trade, simulation), drawn from an
    integer hash; each task folds its trades into n_sims sums, so only those are shuffled.
    """
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sims = np.arange(n_sims, dtype=np.int64)
        sums = np.zeros((3, n_sims))
        steps = np.array(POISSON_STEPS, dtype=np.int64)
        for pdf in batches:
            h, r = pdf["h"].to_numpy(), pdf["r"].to_numpy()
            for at in range(0, len(h), 64):
                part = r[at:at + 64]
                powers = np.stack([np.ones_like(part), part, part * part])
                if h.dtype.kind == "f":  # a batch with a null id
                    u = _uniform(h[at:at + 64, None], sims[None, :])
                    sums += powers @ np.searchsorted(steps, u, side="right").astype(float)
                    continue
                for a in range(0, n_sims, 500):  # a tile stays in the processor's cache
                    sums[:, a:a + 500] += powers @ poisson_weights(h[at:at + 64], sims[a:a + 500]).astype(float)
        yield pd.DataFrame({"sim": sims, "w": sums[0], "wr": sums[1], "wrr": sums[2]})

    picked = trips.select(F.pmod(id_hash.cast("long"), F.lit(PRIME)).alias("h"), F.col("net_pnl").alias("r"))
    return (
        picked.mapInPandas(fold, "sim long, w double, wr double, wrr double")
        .groupBy("sim").agg(F.sum("w").alias("w"), F.sum("wr").alias("wr"), F.sum("wrr").alias("wrr"))
    )


def bootstrap_sharpe(trips: DataFrame, *, id_hash: Column, n_sims: int = SIMULATIONS) -> DataFrame:
    """Per-trade Sharpe ratio with a bootstrap 95 % interval; unavailable below ten trades."""
    m = bootstrap_moments(trips, id_hash=id_hash, n_sims=n_sims)
    mean = F.col("wr") / F.nullif(F.col("w"), F.lit(0.0))
    var = F.col("wrr") / F.nullif(F.col("w"), F.lit(0.0)) - mean * mean
    sharpe = F.when(var > 0, ratio(mean, F.sqrt(var))).otherwise(0.0)
    sims = m.select(sharpe.alias("s")).agg(
        F.percentile("s", 0.025).alias("ci_low"), F.percentile("s", 0.975).alias("ci_high"),
        F.avg((F.col("s") <= 0).cast("double")).alias("p_value"), F.count("*").alias("n_sims"),
        F.lit(1).alias("one"),
    )
    seen = trips.agg(
        F.count("*").alias("n_trades"), F.avg("net_pnl").alias("mean"),
        F.stddev_pop("net_pnl").alias("std"), F.lit(1).alias("one"),
    ).where(F.col("n_trades") >= 10)
    return seen.join(sims, "one").select(
        "n_trades", "n_sims", F.coalesce(ratio(F.col("mean"), F.col("std")), F.lit(0.0)).alias("sharpe"),
        "ci_low", "ci_high", "p_value", (F.col("ci_low") > 0).alias("significant"),
    )


def cost_attribution(trips: DataFrame) -> DataFrame:
    """Gross edge against fees and slippage; undefined figures stay NULL."""
    pnl, net = F.col("pnl"), F.col("net_pnl")
    zero = F.lit(0.0)
    a = trips.agg(
        *_trip_aggregates(),
        F.coalesce(F.sum(pnl), zero).alias("gross_pnl"), F.coalesce(F.sum(net), zero).alias("net_pnl"),
        F.coalesce(F.sum("fee"), zero).alias("fee_drag"),
        F.coalesce(F.sum("slippage"), zero).alias("slippage_drag"),
        F.coalesce(F.avg(F.abs(pnl)), zero).alias("edge_scale"),
        F.coalesce(F.sum(F.when(pnl > 0, pnl)), zero).alias("edge_won"),
        F.abs(F.coalesce(F.sum(F.when(pnl < 0, pnl)), zero)).alias("edge_lost"),
    ).withColumn("total_costs", F.col("fee_drag") + F.col("slippage_drag"))
    n = F.col("round_trips")
    avg_win = F.coalesce(ratio(F.col("gross_profit"), F.col("wins")), zero)
    avg_loss = F.coalesce(ratio(F.col("gross_loss"), F.col("losses")), zero)
    per_trip_edge = F.coalesce(ratio(F.col("gross_pnl"), n), zero)
    per_trip_cost = F.coalesce(ratio(F.col("total_costs"), n), zero)
    return a.select(
        "round_trips", "gross_pnl", "net_pnl", "fee_drag", "slippage_drag", "total_costs",
        per_trip_edge.alias("avg_gross_edge"), per_trip_cost.alias("avg_cost"),
        ratio(avg_loss, avg_win + avg_loss).alias("break_even_winrate"),
        (ratio(per_trip_cost, F.col("edge_scale")) * 1e4).alias("break_even_edge_bps"),
        (ratio(per_trip_edge, F.col("edge_scale")) * 1e4).alias("edge_bps"),
        ratio(F.col("edge_won"), F.col("edge_lost") + F.col("total_costs")).alias("fee_adjusted_profit_factor"),
        ratio(F.col("gross_pnl"), F.col("total_costs")).alias("cost_efficiency"),
        ((F.col("gross_pnl") > 0) & (F.col("net_pnl") < 0)).alias("gross_positive_net_negative"),
    )


# The published backtest expectation and its cost model.
EXPECTED = {"fills": 235, "realized_pnl": -59.0439, "fee_bps": 5.0, "slippage_bps": 2.0}


def reconciliation(positions: DataFrame, *, expected: dict = EXPECTED, pnl_tolerance: float = 0.25,
                   fills_tolerance: float = 0.25) -> DataFrame:
    """Live figures against a backtest expectation, with the reasons for divergence."""
    a = positions.agg(
        F.count("*").alias("fills"),
        F.coalesce(F.sum("realized"), F.lit(0.0)).alias("realized_pnl"),
        F.coalesce(F.sum("transaction_cost"), F.lit(0.0)).alias("fees"),
        F.coalesce(F.sum("fill_slippage"), F.lit(0.0)).alias("slippage"),
        F.coalesce(F.sum(F.abs(F.col("quantity") * F.col("fill_price"))), F.lit(0.0)).alias("notional"),
    )
    want_fills, want_pnl = F.lit(float(expected["fills"])), F.lit(float(expected["realized_pnl"]))
    a = a.withColumns({
        "net_pnl": F.col("realized_pnl") - F.col("fees"),
        "modelled_fees": F.col("notional") * expected["fee_bps"] / 1e4,
        "modelled_slippage": F.col("notional") * expected["slippage_bps"] / 1e4,
        "pnl_delta": F.col("realized_pnl") - want_pnl,
        "pnl_rel": ratio(F.col("realized_pnl") - want_pnl, F.abs(want_pnl)),
        "fills_delta": F.col("fills") - F.lit(expected["fills"]),
        "fills_rel": ratio(F.col("fills") - want_fills, want_fills),
    })
    live = F.col("fills") > 0
    off = lambda rel, tol: live & F.coalesce(F.abs(rel) > tol, F.lit(False))
    a = a.withColumns({
        "fee_model_gap": F.col("fees") - F.col("modelled_fees"),
        "pnl_diverged": off(F.col("pnl_rel"), pnl_tolerance),
        "fills_diverged": off(F.col("fills_rel"), fills_tolerance),
        "fee_model_diverged": live & (F.col("net_pnl") < want_pnl) & (F.col("fees") > F.col("modelled_fees")),
    })
    diverged = F.col("pnl_diverged") | F.col("fills_diverged") | F.col("fee_model_diverged")
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("pnl_diverged"), F.format_string(
            "realized profit %s expectation by %.2f",
            F.when(F.col("pnl_delta") < 0, "below").otherwise("above"), F.abs("pnl_delta"))),
        F.when(F.col("fills_diverged"), F.format_string("fill count off by %d", F.col("fills_delta"))),
        F.when(F.col("fee_model_diverged"), F.lit("net below expectation while fees exceed the cost model")),
    )
    return a.withColumn("diverged", diverged).withColumn(
        "verdict",
        F.when(~live, "no fills yet").when(~diverged, "within tolerance").otherwise(reasons),
    )


def backtest_row(positions: DataFrame, trips: DataFrame, matches: DataFrame, equity: DataFrame, *,
                 initial_cash: float, time="ts", uid="execution_id") -> DataFrame:
    """Hit rate, turnover, average hold, total return, and the equal-notional buy-and-hold."""
    one = F.lit(1).alias("one")
    p = positions.agg(
        F.count("*").alias("fills"),
        (F.sum(F.col("quantity") * F.col("fill_price")) / initial_cash).alias("turnover"), one)
    t = trips.agg(F.coalesce(ratio(F.count_if(_win()), F.count("*")), F.lit(0.0)).alias("hit_rate"), one)
    hold = (F.unix_micros("exit_time") - F.unix_micros("entry_time")) / 1e6
    h = matches.agg(F.avg(hold).alias("avg_hold_secs"), one)
    e = equity.agg((F.max_by("value", F.struct(time, uid)) / initial_cash - 1).alias("total_return"), one)
    edge = positions.groupBy("instrument").agg(
        (F.max_by("fill_price", F.struct(time, uid)) / F.min_by("fill_price", F.struct(time, uid)) - 1).alias("r"))
    b = edge.agg(F.avg("r").alias("buy_and_hold"), one)
    return p.join(t, "one").join(h, "one").join(e, "one").join(b, "one").withColumn(
        "excess_return", F.col("total_return") - F.col("buy_and_hold")).drop("one")

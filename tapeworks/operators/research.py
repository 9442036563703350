"""Alpha research: forward returns, information coefficient, strategies, sweeps, validation."""

from __future__ import annotations

from collections.abc import Callable
from math import e
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.numeric import correlation, ratio
from tapeworks.functions.quantiles import average_ranks
from tapeworks.functions.scan import framed, own_rows, running
from tapeworks.operators.ledger import fifo_match, signed_positions
from tapeworks.session import materialize

FEE_BPS, SLIPPAGE_BPS = 5.0, 2.0
THRESHOLDS = (0.5, 0.6, 0.7, 0.8)
SIZES = (0.01, 0.02)
FOLDS = 4
BAND = 0.05


def forward_returns(df: DataFrame, horizon: int = 1, *, price="midPrice", time="event_time", uid="event_id") -> DataFrame:
    """p(t+h)/p(t) - 1 per instrument; NULL at the end of the series."""
    f, w = framed(df, key=["instrument"], order=[time, uid], before=0, after=horizon)
    f = f.withColumn("fwd_ret", ratio(F.lead(price, horizon).over(w), F.col(price)) - 1)
    return own_rows(f)


def information_coefficient(df: DataFrame, *, signal="obi", ret="fwd_ret", key=("instrument",)) -> DataFrame:
    """Rank correlation of signal and forward return per key, ties at their mean rank; NULL where
    all rows share one signal or one return."""
    key = list(key)
    known = df.where(F.col(signal).isNotNull() & F.col(ret).isNotNull()).select(*key, signal, ret)
    ranked = average_ranks(average_ranks(known, key=key, value=signal, out="__rs"), key=key, value=ret, out="__rr")
    return ranked.groupBy(*key).agg(F.count("*").alias("n"), correlation(F.col("__rs"), F.col("__rr")).alias("ic"))


def rolling_corr(df: DataFrame, *, window: int, signal="obi", ret="fwd_ret", time="event_time", uid="event_id") -> DataFrame:
    """Correlation over each row's last `window` rows; NULL where one side does not move in them."""
    f, w = framed(df, key=["instrument"], order=[time, uid], before=window)
    span = w.rowsBetween(1 - window, 0)
    f = f.withColumns({"corr": correlation(F.col(signal), F.col(ret), span), "n": F.count("*").over(span)})
    return own_rows(f)


def hit_rate(df: DataFrame, *, signal="obi", ret="fwd_ret", key=("instrument",)) -> DataFrame:
    """Share of rows whose signal and forward return have the same sign; zeros are left out."""
    live = df.where((F.col(signal) != 0) & (F.col(ret) != 0))
    same = F.signum(F.col(signal)) == F.signum(F.col(ret))
    return live.groupBy(*key).agg(F.count("*").alias("n"), (F.count_if(same) / F.count("*")).alias("hit_rate"))


STRATEGIES: dict[str, Callable[..., Column]] = {}


def strategy(name: str):
    """Register a strategy: parameters in, a column of -1 (sell), 0 or +1 (buy) out."""
    def add(build):
        STRATEGIES[name] = build
        return build
    return add


@strategy("threshold")
def threshold_strategy(threshold: Column | float = 0.7, signal: str = "obi") -> Column:
    """Contrarian: sell into strong bids, buy into strong asks."""
    x = F.col(signal)
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(x > t, -1).when(x < -t, 1).otherwise(0)


@strategy("vwap_deviation")
def vwap_strategy(band: float = 0.001) -> Column:
    gap = ratio(F.col("close") - F.col("vwap"), F.col("vwap"))
    return F.when(gap > band, -1).when(gap < -band, 1).otherwise(0)


@strategy("ema_crossover")
def ema_strategy(band: float = 0.0) -> Column:
    gap = F.col("ema_fast") - F.col("ema_slow")
    live = F.col("ema_slow") > 0
    return F.when(live & (gap > band), 1).when(live & (gap < -band), -1).otherwise(0)


@strategy("vpin_breakout")
def vpin_strategy(level: float = 0.5) -> Column:
    return F.when(F.col("vpin") > level, F.signum("flow").cast("int")).otherwise(0)


@strategy("ou_zscore")
def ou_strategy(enter: float = 1.5, limit: float = 3.0) -> Column:
    z = F.col("ou_z")
    live = (F.abs(z) >= enter) & (F.abs(z) <= limit)
    return F.when(live & (z > 0), -1).when(live & (z < 0), 1).otherwise(0)


def ou_scores(df: DataFrame, *, window: int = 60, price="close", time="open_time") -> DataFrame:
    """Mean-reversion z-score from a rolling regression of the price step on the price level."""
    f, w = framed(df, key=["instrument"], order=[time], before=window + 1)
    f = f.withColumn("__x", F.lag(price).over(w)).withColumn("__dx", F.col(price) - F.col("__x"))
    span = w.rowsBetween(1 - window, 0)
    f = f.withColumns({
        "n": F.count("__dx").over(span), "__mx": F.avg("__x").over(span), "__md": F.avg("__dx").over(span),
        "__cov": F.covar_pop("__dx", "__x").over(span), "__var": F.var_pop("__x").over(span),
        "__sd": F.stddev_pop(price).over(span),
    })
    slope = ratio(F.col("__cov"), F.col("__var"))
    f = f.withColumn("slope", F.when(F.col("n") >= window, slope))
    f = f.withColumn("level", F.when(F.col("slope") < 0, F.col("__mx") - F.col("__md") / F.nullif(F.col("slope"), F.lit(0.0))))
    f = f.withColumn("ou_z", ratio(F.col(price) - F.col("level"), F.col("__sd")))
    return own_rows(f).drop("__x", "__dx", "__mx", "__md", "__cov", "__var", "__sd")


def strategy_fills(df: DataFrame, way: Column, *, size: Column | float = 0.01, price="midPrice", time="event_time",
                   uid="event_id", fee_bps: float = FEE_BPS, slippage_bps: float = SLIPPAGE_BPS,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """Turn signals into fills at the mid price, worsened by slippage, with a fee."""
    qty = size if isinstance(size, Column) else F.lit(size)
    d = df.withColumn("__way", way).where(F.col("__way") != 0)
    fill_price = F.col(price) * (1 + F.col("__way") * slippage_bps / 1e4)
    d = d.withColumns({"quantity": qty, "fill_price": fill_price})
    return d.select(
        *keep, F.col(uid).alias("execution_id"), F.col(uid).alias("order_id"), "instrument",
        F.when(F.col("__way") > 0, "BUY").otherwise("SELL").alias("side"), "quantity", "fill_price",
        (F.col("quantity") * F.col("fill_price") * fee_bps / 1e4).alias("transaction_cost"),
        F.lit(slippage_bps).alias("slippage_bps"), F.lit("taker").alias("liquidity"), F.col(time).alias("ts"),
    )


def composite(alphas: DataFrame, weights: DataFrame, *, band: float = BAND, key=("instrument", "event_time", "event_id")) -> DataFrame:
    """Weighted sum of a long table of alpha signals; an entry when it leaves the band.

    A score on the band, give or take rounding of the sum, is no entry. Rows are shuffled before
    they are summed, as a sum ahead of it would hold every key of a file's share in one table.
    """
    band = band + 1e-9
    # written, so that Spark knows they are few: shuffled by alpha, all rows would meet in a task each
    w = alphas.join(materialize(weights, "weights"), "alpha").withColumn("contribution", F.col("weight") * F.col("signal"))
    c = w.select(*key, "contribution").repartition(*key).groupBy(*key).agg(F.sum("contribution").alias("score"), F.count("*").alias("alphas"))
    return c.withColumn("entry", F.when(F.col("score") > band, "BUY").when(F.col("score") < -band, "SELL"))


def parameter_grid(thresholds=THRESHOLDS, sizes=SIZES) -> Column:
    """The grid as an array literal: rows are expanded without a join."""
    return F.array(*[
        F.struct(F.lit(f"t{t}_s{s}").alias("combo"), F.lit(t).alias("threshold"), F.lit(s).alias("size"))
        for t in thresholds for s in sizes
    ])


def sweep_fills(features: DataFrame, *, thresholds=THRESHOLDS, sizes=SIZES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fills of the threshold strategy for every parameter combination.

    Rows below the smallest threshold are dropped before the expansion.
    """
    live = features.where(F.abs("obi") > min(thresholds)).withColumn("__g", F.explode(parameter_grid(thresholds, sizes)))
    live = live.select("*", "__g.*").drop("__g")
    return strategy_fills(live, threshold_strategy(F.col("threshold")), size=F.col("size"), keep=("combo", *keep))


def _unit_fills(features: DataFrame, thresholds, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fills of the threshold strategy at size 1, for every threshold: a size only scales them."""
    live = features.where(F.abs("obi") > min(thresholds)).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return strategy_fills(live, threshold_strategy(F.col("threshold")), size=1.0, keep=("threshold", *keep))


_SUMS = ("fills", "realized", "net", "wins", "closes", "notional")


def _unit_sums(pos: DataFrame, key: list[str]) -> DataFrame:
    net = F.col("realized") - F.col("transaction_cost")
    return pos.groupBy(*key).agg(
        F.count("*").alias("fills"), F.sum("realized").alias("realized"), F.sum(net).alias("net"), F.count_if(F.col("opposes") & (net > 0)).alias("wins"),
        F.count_if("opposes").alias("closes"), F.sum(F.col("quantity") * F.col("fill_price")).alias("notional"))


def _sized(sums: DataFrame, keep: list[str], thresholds, sizes, initial_cash: float) -> DataFrame:
    """Results of every combination: the sums of its threshold, multiplied by its size."""
    own = F.filter(parameter_grid(thresholds, sizes), lambda g: g["threshold"] == F.col("threshold"))
    each = sums.withColumn("g", F.explode(own))
    size = F.col("g.size")
    return each.select(
        *keep, "g.combo", "fills", (F.col("realized") * size).alias("realized_pnl"), (F.col("net") * size).alias("net_pnl"),
        F.coalesce(ratio(F.col("wins"), F.col("closes")), F.lit(0.0)).alias("hit_rate"), (F.col("notional") * size / initial_cash).alias("turnover"))


def parameter_sweep(features: DataFrame, *, thresholds=THRESHOLDS, sizes=SIZES, initial_cash: float = 100_000.0) -> DataFrame:
    """Fills, profit, hit rate, turnover and average hold of every combination: one replay per
    threshold, multiplied by the sizes."""
    # both ledgers scan the fills several times
    fills = materialize(_unit_fills(features, thresholds), "sweep")
    sums = _unit_sums(signed_positions(fills, key=("threshold", "instrument")), ["threshold"])
    hold = (F.unix_micros("exit_time") - F.unix_micros("entry_time")) / 1e6
    holds = fifo_match(fills, key=("threshold", "instrument")).groupBy("threshold").agg(F.avg(hold).alias("avg_hold_secs"))
    res = _sized(sums.join(holds, "threshold", "left"), ["avg_hold_secs"], thresholds, sizes, initial_cash)
    return res.select(*[c for c in res.columns if c != "avg_hold_secs"], "avg_hold_secs")


def folds_of(features: DataFrame, folds: int = FOLDS, *, time="event_time", uid="event_id") -> DataFrame:
    """Cut the global time order into folds + 1 equal chunks, numbered from 0."""
    n = features.count()
    size = max(n // (folds + 1), 1)
    ranked = running(features, {"__k": ("count", F.lit(1))}, order=[time, uid])
    return ranked.withColumn("chunk", F.least(F.floor((F.col("__k") - 1) / size), F.lit(folds))).drop("__k")


def fold_results(features: DataFrame, *, folds: int = FOLDS, thresholds=THRESHOLDS, sizes=SIZES,
                 initial_cash: float = 100_000.0) -> DataFrame:
    """Per fold f, side and combination: train on the first f chunks, test on the next one.

    A ledger's rows do not depend on later ones, so one replay of the whole series has the rows
    of every training prefix: sums per chunk, added up along the chunks. Tests start flat, a
    replay per chunk. So each row is replayed twice per threshold, whatever the folds and sizes.
    """
    chunked = folds_of(features, folds)
    c = F.col("chunk")
    whole = F.struct(F.lit("train").alias("part"), F.lit(-1).cast("long").alias("run"))
    own = F.struct(F.lit("test").alias("part"), c.cast("long").alias("run"))
    rows = chunked.withColumn("r", F.explode(F.when(c >= 1, F.array(whole, own)).otherwise(F.array(whole)))).select("*", "r.*").drop("r")
    fills = materialize(_unit_fills(rows, thresholds, keep=("part", "run", "chunk")), "folds")
    pos = signed_positions(fills, key=("part", "run", "threshold", "instrument"))
    sums = materialize(_unit_sums(pos, ["part", "threshold", "chunk"]), "fold-sums")
    later = F.when(F.col("part") == "train", F.filter(F.sequence(F.lit(1), F.lit(folds)), lambda f: f > c)).otherwise(F.array(c.cast("int")))
    per = sums.withColumn("fold", F.explode(later)).groupBy("fold", "part", "threshold").agg(*[F.sum(x).alias(x) for x in _SUMS])
    return _sized(per.withColumn("fold", F.col("fold").cast("int")), ["fold", "part"], thresholds, sizes, initial_cash)


def walk_forward(results: DataFrame) -> DataFrame:
    """The in-sample winner of each fold and what it earned out of sample."""
    best = results.where(F.col("part") == "train").groupBy("fold").agg(
        F.max_by(F.struct("combo", "net_pnl"), F.struct("net_pnl", "combo")).alias("b")
    ).select("fold", F.col("b.combo").alias("combo"), F.col("b.net_pnl").alias("train_pnl"))
    test = results.where(F.col("part") == "test").select(
        "fold", "combo", F.col("net_pnl").alias("test_pnl"), F.col("fills").alias("test_fills"))
    return best.join(test, ["fold", "combo"], "left").withColumn("profitable", F.coalesce(F.col("test_pnl") > 0, F.lit(False)))


def overfitting_probability(results: DataFrame) -> DataFrame:
    """Share of folds whose in-sample best lands in the out-of-sample bottom half; ties count."""
    best = walk_forward(results).select("fold", F.col("combo").alias("best"), F.col("test_pnl").alias("best_pnl"))
    test = results.where(F.col("part") == "test").join(best, "fold")
    per = test.groupBy("fold").agg(
        F.count("*").alias("n"), F.count_if(F.col("net_pnl") >= F.col("best_pnl")).alias("not_worse"))
    # rank from the top, ties at their worst
    low = F.col("not_worse") > F.col("n") / 2
    return per.agg(F.count("*").alias("folds"), F.avg(low.cast("double")).alias("pbo"))


# The rational approximation of the error function by Abramowitz and Stegun, 7.1.26.
_ERF_P, _ERF = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, to about 1e-7."""
    u = F.abs(x) / 2**0.5
    t = 1 / (1 + _ERF_P * u)
    tail = sum((a * F.pow(t, F.lit(i + 1)) for i, a in enumerate(_ERF)), F.lit(0.0)) * F.exp(-u * u) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    """The same as SQL text."""
    u = f"(abs({x}) / sqrt(2))"
    tail = "(" + " + ".join(f"({a}) * power(1 / (1 + {_ERF_P} * {u}), {i + 1})" for i, a in enumerate(_ERF)) + f") * exp(-{u} * {u}) / 2"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


EULER_GAMMA = 0.5772156649015329


def expected_maximum(n: int) -> float:
    """The largest of n independent standard normal draws, on average (nearly)."""
    norm = NormalDist()
    return (1 - EULER_GAMMA) * norm.inv_cdf(1 - 1 / n) + EULER_GAMMA * norm.inv_cdf(1 - 1 / (n * e)) if n > 1 else 0.0


def sweep_trips(features: DataFrame, *, thresholds=THRESHOLDS, sizes=SIZES) -> DataFrame:
    """The closing fills of every parameter combination over the whole sample, with net profit."""
    fills = materialize(sweep_fills(features, thresholds=thresholds, sizes=sizes), "sweep")
    pos = signed_positions(fills, key=("combo", "instrument"))
    return pos.where("opposes").select("combo", (F.col("realized") - F.col("transaction_cost")).alias("net_pnl"))


def trial_sharpes(trips: DataFrame) -> DataFrame:
    """One row per combination: mean over deviation of its trips."""
    return trips.groupBy("combo").agg(ratio(F.avg("net_pnl"), F.stddev_pop("net_pnl")).alias("sharpe"))


def best_trial(trips: DataFrame, trials: DataFrame) -> DataFrame:
    """The trips of the combination with the best Sharpe ratio."""
    best = trials.orderBy(F.desc("sharpe"), "combo").limit(1).select("combo")
    return trips.join(best, "combo", "left_semi")


def deflated_sharpe(trips: DataFrame, trials: DataFrame) -> DataFrame:
    """Probability that the observed Sharpe ratio beats the best of N lucky trials.

    `trials` has one Sharpe ratio per tried combination in `sharpe`.
    """
    t = trials.agg(F.count("*").alias("n_trials"), F.var_samp("sharpe").alias("v")).first()
    n, v = t["n_trials"], t["v"] or 0.0
    m = trips.agg(F.count("*").alias("n"), F.avg("net_pnl").alias("mean"), F.stddev_pop("net_pnl").alias("std"),
                  F.skewness("net_pnl").alias("skew"), (F.kurtosis("net_pnl") + 3).alias("kurt"))
    s = ratio(F.col("mean"), F.col("std"))
    m = m.withColumn("sharpe", s).withColumn("expected_max_sharpe", F.lit(v**0.5 * expected_maximum(n))).withColumn("n_trials", F.lit(n))
    spread = F.sqrt(F.greatest(1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") ** 2, F.lit(1e-12)))
    z = (F.col("sharpe") - F.col("expected_max_sharpe")) * F.sqrt(F.greatest(F.col("n") - 1, F.lit(0))) / spread
    return m.withColumn("dsr", normal_cdf(z))

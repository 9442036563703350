"""Order-book, trend, volatility, volume and regime features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.asof import asof_join
from tapeworks.functions.numeric import ratio
from tapeworks.functions.scan import framed, order_cuts, own_rows, running

LEVELS = 10
LOOKBACK = 30
FAST, SLOW = 12, 26
TREND_BAND = 0.0005
ATR_BARS = 14
RECENT_BARS = 5
VOLUME_SPIKE = 2.0
REGIME_WINDOW, REGIME_MIN_PRICES, REGIME_MIN_RETURNS = 60, 20, 10
BARS_PER_YEAR = 252 * 24 * 12
SIGNAL_THRESHOLD = 0.7


def _volume(levels: Column) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + x["qty"])


def order_book_imbalance(books: DataFrame, *, levels: int = LEVELS) -> DataFrame:
    """Imbalance, volumes, best prices, spread, mid and micro-price of each snapshot."""
    bids, asks = F.slice("bids", 1, levels), F.slice("asks", 1, levels)
    b, a = _volume(bids), _volume(asks)
    top_bid, top_ask = F.try_element_at("bids", F.lit(1)), F.try_element_at("asks", F.lit(1))
    best_bid = F.coalesce(top_bid["price"], F.lit(0.0))
    best_ask = F.coalesce(top_ask["price"], F.lit(0.0))
    both = (best_bid != 0) & (best_ask != 0)
    size = top_bid["qty"] + top_ask["qty"]
    return books.withColumns({
        "obi": F.when(b + a > 0, ratio(b - a, b + a)).otherwise(0.0),
        "bid_volume": b, "ask_volume": a, "best_bid": best_bid, "best_ask": best_ask,
        "spread": best_ask - best_bid,
        "mid": F.when(both, (best_bid + best_ask) / 2).otherwise(0.0),
        "levels": F.least(F.size(bids), F.size(asks), F.lit(levels)),
        "micro_price": F.when(both, ratio(best_bid * top_ask["qty"] + best_ask * top_bid["qty"], size)),
    })


def ema(closes: Column, period: int) -> Column:
    """Exponential mean of an array: simple mean of the first `period`, then recursive."""
    k = 2.0 / (period + 1)
    seed = F.aggregate(F.slice(closes, 1, period), F.lit(0.0), lambda acc, x: acc + x) / period
    rest = F.slice(closes, F.lit(period + 1), F.greatest(F.size(closes) - period, F.lit(0)))
    return F.when(F.size(closes) < period, F.element_at(closes, -1)).otherwise(
        F.aggregate(rest, seed, lambda acc, x: (x - acc) * k + acc))


def bar_signals(bars: DataFrame, *, time="open_time") -> DataFrame:
    """Momentum, ATR volatility and volume context of every bar over its look-back."""
    f, w = framed(bars, key=["instrument"], order=[time], before=LOOKBACK)
    back = lambda a, b: w.rowsBetween(a, b)
    closes = F.collect_list("close").over(back(1 - LOOKBACK, 0))
    f = f.withColumns({
        "__closes": closes, "__prev": F.lag("close").over(w),
        "bars": F.count("*").over(back(1 - LOOKBACK, 0)),
        "__recent": F.avg("volume").over(back(1 - RECENT_BARS, 0)),
        "__older": F.avg("volume").over(back(1 - LOOKBACK, -RECENT_BARS)),
        "__n": F.count("*").over(back(1 - ATR_BARS, 0)),
        "__hl": F.first(F.col("high") - F.col("low")).over(back(1 - ATR_BARS, 0)),
    })
    hl = F.col("high") - F.col("low")
    f = f.withColumn("__tr", F.greatest(hl, F.abs(F.col("high") - F.col("__prev")), F.abs(F.col("low") - F.col("__prev"))))
    f = f.withColumn("__tr", F.when(F.col("__prev").isNull(), hl).otherwise(F.col("__tr")))
    # the oldest of the 14 bars counts with its own range only
    f = f.withColumn("__sum", F.sum("__tr").over(back(2 - ATR_BARS, 0)))
    f = own_rows(f)
    fast, slow = ema(F.col("__closes"), FAST), ema(F.col("__closes"), SLOW)
    ready = F.col("bars") >= SLOW
    atr = (F.col("__sum") + F.when(F.col("__n") == ATR_BARS, F.col("__hl")).otherwise(0.0)) / F.col("__n")
    f = f.withColumns({
        "ema_fast": F.when(ready, fast).otherwise(0.0), "ema_slow": F.when(ready, slow).otherwise(0.0),
        "atr": F.when(F.col("__n") >= 5, atr).otherwise(0.0),
        "volume_ratio": F.when(F.col("__older") > 0, ratio(F.col("__recent"), F.col("__older"))).otherwise(1.0),
    })
    momentum = F.when(F.col("ema_slow") > 0, ratio(F.col("ema_fast") - F.col("ema_slow"), F.col("ema_slow"))).otherwise(0.0)
    f = f.withColumns({
        "momentum": momentum,
        "volatility": F.when(F.col("close") > 0, ratio(F.col("atr"), F.col("close"))).otherwise(0.0),
        "volume_spike": F.col("volume_ratio") > VOLUME_SPIKE,
    })
    m, v = F.col("momentum"), F.col("volatility")
    return f.withColumns({
        "trend": F.when(m > TREND_BAND, "bullish").when(m < -TREND_BAND, "bearish").otherwise("neutral"),
        "volatility_regime": F.when(F.col("__n") < 5, "unknown").when(v > 0.015, "high")
        .when(v > 0.005, "medium").otherwise("low"),
    }).drop("__closes", "__prev", "__recent", "__older", "__n", "__hl", "__tr", "__sum")


def multi_timeframe_momentum(m1: DataFrame, m5: DataFrame, m15: DataFrame) -> DataFrame:
    """5-minute signals with the latest closed 1- and 15-minute momentum."""
    out = m5
    for other, name in ((m1, "momentum_1m"), (m15, "momentum_15m")):
        out = asof_join(
            out, other, left_time="close_time", right_time="close_time", left_uid="open_time",
            right_uid="open_time", take={name: "momentum"},
        )
    return out


def oi_change(interest: DataFrame, *, value="open_interest", time="ts", uid="event_id") -> DataFrame:
    """Relative change of open interest; 0 when there is no positive previous value."""
    lagged = running(interest, {"__p": ("lag", F.col(value))}, key=["instrument"], order=[time, uid])
    change = F.when(F.col("__p") > 0, (F.col(value) - F.col("__p")) / F.nullif(F.col("__p"), F.lit(0.0)))
    return lagged.withColumn("oi_change", F.coalesce(change, F.lit(0.0))).drop("__p")


def return_stats(prices: DataFrame, *, price="close", time="open_time", window: int = REGIME_WINDOW,
                 bars_per_year: int = BARS_PER_YEAR) -> DataFrame:
    """Rolling log-return mean, deviation, annualized volatility, range exponent and lag-1
    autocorrelation over the last `window` returns."""
    f, w = framed(prices, key=["instrument"], order=[time], before=window + 1)
    prev = F.lag(price).over(w)
    f = f.withColumn("ret", F.when((prev > 0) & (F.col(price) > 0), F.ln(F.col(price) / prev)))
    f = f.withColumn("__r0", F.lag("ret").over(w))
    span, pairs = w.rowsBetween(1 - window, 0), w.rowsBetween(2 - window, 0)
    later = F.when(F.col("__r0").isNotNull(), F.col("ret"))
    f = f.withColumns({
        "prices": F.least(F.count(price).over(w.rowsBetween(-window, 0)), F.lit(window + 1)),
        "n": F.count("ret").over(span), "mean": F.avg("ret").over(span),
        "std": F.stddev_pop("ret").over(span), "__r": F.collect_list("ret").over(span),
        "__cov": F.covar_pop("__r0", "ret").over(pairs), "__va": F.var_pop("__r0").over(pairs),
        "__vb": F.var_pop(later).over(pairs),
    })
    f = own_rows(f)
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

    def walk(acc, r):
        c = acc["c"] + r - F.col("mean")
        return F.struct(c.alias("c"), F.least(acc["lo"], c).alias("lo"), F.greatest(acc["hi"], c).alias("hi"))

    # the mean differs from row to row, so the range of the deviations is a fold over 60 values
    reach = F.aggregate("__r", start, walk, lambda acc: acc["hi"] - acc["lo"])
    f = f.withColumns({"std": F.when(F.col("std") > 0, F.col("std")).otherwise(1e-10), "__range": reach})
    den = F.when((F.col("__va") > 0) & (F.col("__vb") > 0), F.sqrt(F.col("__va") * F.col("__vb"))).otherwise(1.0)
    return f.withColumns({
        "volatility_ann": F.col("std") * float(bars_per_year) ** 0.5,
        "hurst": F.when(F.col("n") > 1, F.ln(F.col("__range") / F.col("std") + 1e-10) / F.nullif(F.ln(F.col("n")), F.lit(0.0))),
        "autocorr": F.when(F.col("n") > 2, F.col("__cov") / den).otherwise(0.0),
    }).drop("__r", "__r0", "__range", "__cov", "__va", "__vb")


def classify_regime(stats: DataFrame) -> DataFrame:
    """volatile, trending, mean_reverting or quiet, with a confidence; unknown while too short."""
    vol, h, ac = F.col("volatility_ann"), F.col("hurst"), F.col("autocorr")
    drift = F.abs(F.col("mean") / F.col("std"))
    known = (F.col("prices") >= REGIME_MIN_PRICES) & (F.col("n") >= REGIME_MIN_RETURNS)
    one = F.lit(1.0)
    rules = [
        ((vol > 0.8) & (drift < 0.5), "volatile", F.least(vol / 1.2, one)),
        ((drift > 1.0) & (h > 0.55), "trending", F.least(drift / 2, one)),
        ((ac < -0.15) & (vol < 0.6), "mean_reverting", F.least(F.abs(ac) / 0.3, one)),
        (vol < 0.3, "quiet", 1 - vol / 0.3),
    ]
    regime, conf = F.when(~known, "unknown"), F.when(~known, 0.0)
    for cond, name, c in rules:
        regime, conf = regime.when(cond, name), conf.when(cond, c)
    keep = lambda c, d: F.when(known, F.col(c)).otherwise(d)
    return stats.withColumns({
        "regime": regime.otherwise("mean_reverting"), "confidence": conf.otherwise(0.4),
        "volatility_ann": keep("volatility_ann", 0.0), "hurst": keep("hurst", 0.5), "autocorr": keep("autocorr", 0.0),
    })


def assemble_events(bars5: DataFrame, books: DataFrame, *, extra: dict[str, Column] | None = None) -> DataFrame:
    """One feature event per 5-minute bar: numeric `values` map plus where each input came from.

    `bars5` holds the bar signals and regime columns, `books` the imbalance columns with a
    `book_id` and `ts`.
    """
    cols = ["obi", "bid_volume", "ask_volume", "spread", "mid", "levels", "book_id", "symbol"]
    e = asof_join(bars5, books, left_time="close_time", right_time="ts", left_uid="open_time",
                  right_uid="book_id", take={f"__b_{c}": c for c in cols})
    have = e.columns
    pick = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in have else F.lit(d)
    values = {
        "obi": pick("__b_obi"), "bidVolume": pick("__b_bid_volume"), "askVolume": pick("__b_ask_volume"),
        "spread": pick("__b_spread"), "midPrice": pick("__b_mid"), "levels": pick("__b_levels"),
        "momentum": pick("momentum"), "momentum1m": pick("momentum_1m"), "momentum15m": pick("momentum_15m"),
        "emaFast": pick("ema_fast"), "emaSlow": pick("ema_slow"), "volatility": pick("volatility"),
        "atr": pick("atr"), "volumeRatio": pick("volume_ratio", 1.0), "fearGreed": pick("fear_greed", 50.0),
        "fundingRate": pick("funding_rate"), "oiChange": pick("oi_change"), "mlScore": pick("ml_score", 0.5),
        "mlReady": pick("ml_ready"), "newsSentiment": pick("news_sentiment"),
        "regimeVolAnn": pick("volatility_ann"), "regimeHurst": pick("hurst", 0.5),
        "regimeAutocorr": pick("autocorr"), "regimeConfidence": pick("confidence"),
        **(extra or {}),
    }
    close_ms = F.unix_millis("close_time")
    symbol = F.replace(F.col("instrument"), F.lit("-"), F.lit(""))
    ids = F.array_compact(F.array(
        F.when(F.col("__b_book_id").isNotNull(), F.concat_ws(":", F.lit("orderbook"), symbol, F.col("__b_book_id").cast("string"))),
        F.concat_ws(":", F.lit("kline5m"), symbol, close_ms.cast("string")),
    ))
    return e.select(
        F.sha2(F.concat_ws("|", "instrument", close_ms.cast("string")), 256).alias("event_id"), "instrument",
        F.col("close_time").alias("event_time"), F.col("open_time").alias("window_start"),
        F.col("close_time").alias("window_end"), close_ms.alias("signal_time_ms"),
        F.lit("obi").alias("feature_name"), F.lit("v1").alias("feature_version"), ids.alias("input_event_ids"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*values.values())).alias("values"),
    )


def signal_flags(features: DataFrame, *, threshold: float = SIGNAL_THRESHOLD) -> DataFrame:
    fires = F.abs("obi") > threshold
    return features.withColumns({
        "signal": fires, "signal_side": F.when(fires, F.when(F.col("obi") > 0, "SELL").otherwise("BUY")),
    })


def signal_counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("instrument").agg(
        F.count("*").alias("published"), F.count_if("signal").alias("signals"),
        F.count_if(F.col("signal_side") == "SELL").alias("sells"), F.count_if(F.col("signal_side") == "BUY").alias("buys"),
    )


def lineage_edges(events: DataFrame) -> DataFrame:
    """(input, event) edges, typed by the input's prefix."""
    return events.select("event_id", F.explode("input_event_ids").alias("input_id")).withColumn(
        "input_type", F.split_part(F.col("input_id"), F.lit(":"), F.lit(1)))


def vpin(ticks: DataFrame, *, bucket_volume: float, buckets: int = 50, time="ts", uid="tick_id") -> DataFrame:
    """Volume-synchronized order-flow imbalance.

    Ticks are laid on the axis of cumulative volume and cut into equal volume buckets, a tick
    across a border being split. Flow is signed by the tick rule.
    """
    order = [time, uid]
    cuts = order_cuts(ticks, order)
    t = running(ticks, {"__p": ("lag", F.col("price"))}, key=["instrument"], order=order, cuts=cuts)
    move = F.signum(F.col("price") - F.col("__p"))
    t = t.withColumn("__m", F.when(move != 0, move))
    qty = F.col("quantity").cast("decimal(28,12)")
    t = running(t, {"__way": ("last", F.col("__m")), "__end": ("sum", qty)}, key=["instrument"], order=order, cuts=cuts)
    end = F.col("__end").cast("double")
    start = (F.col("__end") - qty).cast("double")
    t = t.select(
        "instrument", time, F.coalesce("__way", F.lit(1.0)).alias("way"), start.alias("s"), end.alias("e"),
        F.explode(F.sequence(F.floor(start / bucket_volume),
                             F.greatest(F.ceil(end / bucket_volume) - 1, F.floor(start / bucket_volume)))).alias("bucket"),
    )
    part = F.least(F.col("e"), (F.col("bucket") + 1) * bucket_volume) - F.greatest(F.col("s"), F.col("bucket") * bucket_volume)
    b = t.groupBy("instrument", "bucket").agg(
        F.sum(part).alias("volume"), F.sum(part * F.col("way")).alias("flow"), F.max(time).alias("bucket_end"))
    full = b.where(F.col("volume") >= bucket_volume * (1 - 1e-9)).withColumn("imbalance", F.abs("flow") / bucket_volume)
    f, w = framed(full, key=["instrument"], order=["bucket"], before=buckets)
    f = f.withColumns({
        "vpin": F.avg("imbalance").over(w.rowsBetween(1 - buckets, 0)),
        "buckets": F.count("*").over(w.rowsBetween(1 - buckets, 0)),
    })
    return own_rows(f).select("instrument", "bucket", "bucket_end", "flow", "imbalance", "vpin", "buckets")

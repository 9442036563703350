"""Rule-based trade decisions and why they were taken or blocked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.asof import asof_join
from tapeworks.functions.numeric import ratio

THRESHOLD = 0.90
# The limits of the decision rules.
HIGH_VOLATILITY, EXTRA_THRESHOLD = 0.015, 0.05
VOLUME_SPIKE, TREND = 3.0, 0.002
EXTREME_FEAR, EXTREME_GREED = 20.0, 80.0
DEFAULTS = {"obi": 0.0, "momentum": 0.0, "volatility": 0.0, "fearGreed": 50.0, "volumeRatio": 1.0, "midPrice": 0.0}


def _v(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(DEFAULTS[name]))


def decide(features: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Outcome of each feature event: no_signal, blocked (with the rule) or trade.

    A value exactly on the threshold is no signal and is not counted.
    """
    obi = _v("obi")
    eff = F.lit(threshold) + F.when(_v("volatility") > HIGH_VOLATILITY, EXTRA_THRESHOLD).otherwise(0.0)
    side = F.when(obi > eff, "SELL").when(obi < -eff, "BUY")
    sell = side == "SELL"
    against = F.when(sell, _v("momentum") > TREND).otherwise(_v("momentum") < -TREND)
    mood = F.when(sell, (_v("fearGreed") > 0) & (_v("fearGreed") < EXTREME_FEAR)).otherwise(
        _v("fearGreed") > EXTREME_GREED)
    blocked = F.when(side.isNotNull(), F.when(_v("volumeRatio") > VOLUME_SPIKE, "volume_spike")
                     .when(against, "momentum").when(mood, "sentiment"))
    d = features.withColumns({
        "threshold": eff, "side": side, "would_have_traded": side.isNotNull(), "blocked_by": blocked,
        "counted": F.abs(obi) != eff,
    })
    return d.withColumn(
        "type",
        F.when(F.col("side").isNull(), "no_signal").when(F.col("blocked_by").isNotNull(), "blocked")
        .otherwise("trade"),
    )


def explain_decisions(decisions: DataFrame) -> DataFrame:
    """A sentence with the facts behind each outcome."""
    head = F.format_string("%s signal: imbalance %+.4f beyond %.2f.", F.col("side"), _v("obi"), F.col("threshold"))
    why = (
        F.when(F.col("blocked_by") == "volume_spike",
               F.format_string("Blocked, volume is %.1f times normal.", _v("volumeRatio")))
        .when(F.col("blocked_by") == "momentum",
              F.format_string("Blocked, momentum %+.4f runs against the trade.", _v("momentum")))
        .when(F.col("blocked_by") == "sentiment",
              F.format_string("Blocked, fear and greed index at %.0f.", _v("fearGreed")))
        .otherwise(F.format_string(
            "Taken at about %.2f: momentum %+.4f, volatility %.4f, fear and greed %.0f.",
            _v("midPrice"), _v("momentum"), _v("volatility"), _v("fearGreed")))
    )
    none = F.format_string("Imbalance %+.4f stays within %.2f, no signal.", _v("obi"), F.col("threshold"))
    text = F.when(~F.col("counted"), "").when(F.col("type") == "no_signal", none).otherwise(F.concat_ws(" ", head, why))
    return decisions.withColumn("explanation", text)


def decision_stats(decisions: DataFrame) -> DataFrame:
    def n(kind, rule=None):
        cond = F.col("counted") & (F.col("type") == kind)
        return F.count_if(cond & (F.col("blocked_by") == rule) if rule else cond)

    a = decisions.agg(
        F.count_if("counted").alias("total"), n("no_signal").alias("no_signal"), n("trade").alias("traded"),
        n("blocked", "volume_spike").alias("blocked_volume"), n("blocked", "momentum").alias("blocked_momentum"),
        n("blocked", "sentiment").alias("blocked_sentiment"),
    )
    blocked = F.col("blocked_volume") + F.col("blocked_momentum") + F.col("blocked_sentiment")
    return a.withColumns({"blocked_total": blocked, "would_have_traded": blocked + F.col("traded")}).withColumn(
        "block_rate", ratio(F.col("blocked_total"), F.greatest("would_have_traded", F.lit(1))))


def recent_decisions(decisions: DataFrame, *, limit: int = 50, kind: str | None = None, time="event_time",
                     uid="event_id") -> DataFrame:
    """Filter by type first, then the newest rows."""
    d = decisions.where(F.col("type") == kind) if kind else decisions
    return d.orderBy(F.desc(time), F.desc(uid)).limit(limit)


def next_fill(decisions: DataFrame, fills: DataFrame, *, tolerance: str, time="event_time", uid="event_id") -> DataFrame:
    """The first fill at or after each trade decision within the tolerance."""
    return asof_join(
        decisions.where(F.col("type") == "trade"), fills, left_time=time, right_time="ts", left_uid=uid,
        right_uid="execution_id", take={"fill_id": "execution_id", "fill_ts": "ts", "fill_side": "side"},
        tolerance=tolerance, forward=True,
    )

"""Pipeline-quality queries over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.quantiles import exact_quantiles
from tapeworks.functions.scan import running

LATENCY_LIMIT_MS = 256.0
WINDOWS_MIN = {"5m": 5, "30m": 30, "1h": 60, "6h": 360}
LATENCY_BUDGET, READINESS_BUDGET = 0.01, 0.005
FAST_BURN, SLOW_BURN = 14.4, 6.0
GAP_MINUTES = (2, 5, 10, 20, 30)
_DAY = 1440


def _rolling(per_minute: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
    """Trailing sums over each window on 1-minute partials, in day chunks with a 6 h overlap."""
    longest = max(WINDOWS_MIN.values())
    m = F.col("minute")
    day = F.floor(m / _DAY)
    spread = per_minute.withColumn("__day", F.explode(F.array_compact(F.array(
        day, F.when(m % _DAY >= _DAY - longest + 1, day + 1)))))
    w = Window.partitionBy(*key, "__day").orderBy("minute")
    out = spread.withColumns({
        f"{c}_{name}": F.sum(c).over(w.rangeBetween(1 - n, 0)) for c in sums for name, n in WINDOWS_MIN.items()
    })
    return out.where(F.floor(m / _DAY) == F.col("__day")).drop("__day")


def latency_bad_ratio(events: DataFrame, *, key=("job",), time="ts", latency="latency_ms",
                      limit: float = LATENCY_LIMIT_MS) -> DataFrame:
    """Share of slow events over each trailing window, for every minute that has events."""
    key = list(key)
    per = events.groupBy(*key, F.floor(F.unix_seconds(time) / 60).alias("minute")).agg(
        F.count_if(F.col(latency) > limit).alias("bad"), F.count("*").alias("total"))
    r = _rolling(per, key, ["bad", "total"])
    return r.select(*key, "minute", *[
        (F.col(f"bad_{n}") / F.greatest(F.col(f"total_{n}"), F.lit(1))).alias(f"bad_{n}") for n in WINDOWS_MIN])


def burn_alerts(ratios: DataFrame, *, prefix: str = "bad", budget: float = LATENCY_BUDGET) -> DataFrame:
    """Fast burn needs the 1 h and 5 m windows over the limit, slow burn the 6 h and 30 m ones."""
    over = lambda n, k: F.col(f"{prefix}_{n}") > k * budget
    return ratios.withColumns({
        "fast_burn": over("1h", FAST_BURN) & over("5m", FAST_BURN),
        "slow_burn": over("6h", SLOW_BURN) & over("30m", SLOW_BURN),
    })


def freshness_gaps(events: DataFrame, *, key=("job",), time="ts", uid="event_id") -> DataFrame:
    """Silent stretches longer than each limit: how many, and the longest."""
    key = list(key)
    lagged = running(events.select(*key, time, uid), {"__p": ("lag", F.col(time))}, key=key, order=[time, uid])
    gap = (F.unix_micros(time) - F.unix_micros("__p")) / 1e6
    gaps = lagged.select(*key, gap.alias("gap")).where(F.col("gap") > min(GAP_MINUTES) * 60)
    hit = F.filter(F.array(*[F.lit(m) for m in GAP_MINUTES]), lambda m: F.col("gap") > m * 60)
    return gaps.select(*key, "gap", F.explode(hit).alias("limit_min")).groupBy(*key, "limit_min").agg(
        F.count("*").alias("gaps"), F.max("gap").alias("longest_secs"))


def unavailability(events: DataFrame, *, key=("job",), time="ts", up="up") -> DataFrame:
    """1 - mean(up) over each trailing window per job."""
    key = list(key)
    per = events.groupBy(*key, F.floor(F.unix_seconds(time) / 60).alias("minute")).agg(
        F.count_if(up).alias("up"), F.count("*").alias("total"))
    r = _rolling(per, key, ["up", "total"])
    return r.select(*key, "minute", *[
        (1 - F.col(f"up_{n}") / F.col(f"total_{n}")).alias(f"down_{n}") for n in WINDOWS_MIN])


def worst_unavailability(per_job: DataFrame) -> DataFrame:
    """The worst job at each minute, with its burn flags."""
    m = per_job.groupBy("minute").agg(*[F.max(f"down_{n}").alias(f"down_{n}") for n in WINDOWS_MIN])
    return burn_alerts(m, prefix="down", budget=READINESS_BUDGET)


def latency_quantiles(events: DataFrame, *, key=("job",), latency="latency_ms") -> DataFrame:
    return exact_quantiles(events, key=list(key), value=latency, probs={"p50": 0.5, "p95": 0.95, "p99": 0.99})


def rates(events: DataFrame, *, key: list[str | Column], time="ts", width: str = "1 minute") -> DataFrame:
    return events.groupBy(F.window(time, width)["start"].alias("window_start"), *key).agg(F.count("*").alias("n"))

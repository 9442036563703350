"""Bars and volume-weighted prices from ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTHS = ("1 minute", "5 minutes", "15 minutes")


def bars(ticks: DataFrame, width: str = "5 minutes", *, time="ts", uid="tick_id") -> DataFrame:
    """Open, high, low, close, volume and VWAP per instrument and tumbling window."""
    at = F.struct(time, uid)
    return (
        ticks.groupBy("instrument", F.window(time, width).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"),
            (F.sum(F.col("price") * F.col("quantity")) / F.nullif(F.sum("quantity"), F.lit(0.0))).alias("vwap"),
            F.count("*").alias("ticks"),
        )
        .select("instrument", F.col("w.start").alias("open_time"), F.col("w.end").alias("close_time"),
                "open", "high", "low", "close", "volume", "vwap", "ticks")
    )


def vwap(ticks: DataFrame, width: str = "1 minute", *, time="ts") -> DataFrame:
    return ticks.groupBy("instrument", F.window(time, width)["start"].alias("open_time")).agg(
        (F.sum(F.col("price") * F.col("quantity")) / F.nullif(F.sum("quantity"), F.lit(0.0))).alias("vwap"),
        F.sum("quantity").alias("volume"),
    )

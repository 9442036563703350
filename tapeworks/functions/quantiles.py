"""Exact quantiles and ranks that stay distributed when one group or one value is very common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.scan import running


def exact_quantiles(df: DataFrame, *, key: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per key, one column per entry of `probs`.

    Equal values are folded into counts first; a running count then finds the two rows each
    quantile lies between.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    upto = running(counts, {"__n": ("sum", F.col("__c"))}, key=key, order=["__v"])
    if key:
        # one row per key; a common key meets it by broadcast or by a split skewed partition
        joined = upto.join(counts.groupBy(*key).agg(F.sum("__c").alias("__m")), key)
    else:
        joined = upto.withColumn("__m", F.lit(counts.agg(F.sum("__c")).first()[0]))
    aggs = []
    for i, p in enumerate(probs.values()):
        at = F.lit(p) * (F.col("__m") - 1)
        low = F.floor(at)
        aggs += [
            F.min(F.when(F.col("__n") >= low + 1, F.col("__v"))).alias(f"__lo{i}"),
            F.min(F.when(F.col("__n") >= F.least(low + 2, F.col("__m")), F.col("__v"))).alias(f"__hi{i}"),
            F.first(at - low).alias(f"__w{i}"),
        ]
    g = joined.groupBy(*key).agg(*aggs)
    return g.select(*key, *[
        (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__w{i}")).alias(name)
        for i, name in enumerate(probs)
    ])


def average_ranks(df: DataFrame, *, key: list[str], value: str, out: str) -> DataFrame:
    """Rank per key with ties at their mean rank; the rank table has one row per distinct value."""
    counts = df.groupBy(*key, value).agg(F.count("*").alias("__c"))
    upto = running(counts, {"__n": ("sum", F.col("__c"))}, key=key, order=[value])
    table = upto.select(*key, value, (F.col("__n") - (F.col("__c") - 1) / 2).alias(out))
    return df.join(table, [*key, value])

"""Running totals along a total order, with no task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm._rows import partitions
from tapeworks.session import materialize

PART = "__part"


def running_before(df: DataFrame, order: list[str], totals: dict[str, Column], key: str | None = None) -> DataFrame:
    """Add, for each {name: value}, the sum of value over all earlier rows (of the same key).

    df is slim; key is a column without nulls. Rows are cut into ranges of (key, order), so a
    hot key spreads over many tasks; the sums of the ranges, one row for each key and range,
    carry over. Rows that tie in order count in either order, so order should be total.
    """
    key_cols = [key] if key else []
    ranged = df.repartitionByRange(partitions(df.sparkSession), *key_cols, *order)
    ranged = materialize(ranged.withColumn(PART, F.spark_partition_id()), "ranges")
    group = [*key_cols, PART]
    sums = ranged.groupBy(*group).agg(*[F.sum(v).alias(f"__t_{n}") for n, v in totals.items()])
    upto = Window.partitionBy(*key_cols).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*group, *[F.coalesce(F.sum(f"__t_{n}").over(upto), F.lit(0)).alias(f"__c_{n}") for n in totals])
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in totals.items()})
    out = local.join(carry, group)
    return out.withColumns({n: F.col(n) + F.col(f"__c_{n}") for n in totals}).drop(PART, *[f"__c_{n}" for n in totals])

"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def finite(col: Column) -> Column:
    """The value as double when it is a finite number, else NULL."""
    x = col.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def blank_to_null(col: Column) -> Column:
    text = F.trim(col.cast("string"))
    return F.when(text != "", text)


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(col, F.lit(high)), F.lit(low))


def ratio(num: Column, den: Column) -> Column:
    """NULL instead of an error or an invented number when the denominator is 0."""
    return num / F.nullif(den, F.lit(0).cast("double"))


def correlation(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson's correlation of the pairs without a NULL, as an aggregate or over a window; NULL
    where one side is the same in all pairs."""
    within = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    own, other = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return ratio(within(F.covar_pop(x, y)), within(F.stddev_pop(own)) * within(F.stddev_pop(other)))


def seconds(col: Column) -> Column:
    """Epoch seconds with fraction."""
    return F.unix_micros(col) / F.lit(1e6)

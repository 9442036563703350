"""As-of joins: for each left row the last right row at or before it, in one linear pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.scan import Cuts, running

_T, _SIDE, _UID, _PAY = "__t", "__side", "__uid", "__pay"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    key=("instrument",),
    left_time: str,
    right_time: str,
    left_uid: str,
    right_uid: str,
    take: dict[str, str],
    strict: bool = False,
    tolerance: str | None = None,
    forward: bool = False,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Left rows plus `take` = {new name: right column} of the nearest right row in time.

    Backward by default; `forward` looks ahead. `strict` leaves equal times out. `tolerance`
    is an interval text such as "60 seconds". Both sides travel through one shuffle; the
    last right row of each block is carried on by the scan, so a hot key is split in time.
    """
    key = list(key)
    # at equal times the right row must come first when inclusive, last when strict
    right_side = int(strict) if not forward else int(not strict)
    pay = F.struct(F.col(right_time).alias("t"), *[F.col(c).alias(n) for n, c in take.items()])
    r = right.select(
        *key, F.col(right_time).alias(_T), F.lit(right_side).alias(_SIDE),
        F.col(right_uid).cast("string").alias(_UID), pay.alias(_PAY), F.lit(None).alias("__row"),
    )
    l = left.select(
        *key, F.col(left_time).alias(_T), F.lit(1 - right_side).alias(_SIDE),
        F.col(left_uid).cast("string").alias(_UID), F.lit(None).alias(_PAY),
        F.struct(*[F.col(c) for c in left.columns if c not in key]).alias("__row"),
    )
    both = l.unionByName(r)
    found = running(
        both, {"__hit": ("last", F.col(_PAY))}, key=key, order=[_T, _SIDE, _UID],
        cuts=cuts, descending=forward,
    ).where(F.col("__row").isNotNull())
    hit = F.col("__hit")
    ok: Column = hit.isNotNull()
    if tolerance:
        gap = F.expr(f"interval {tolerance}")
        own = F.col(_T)
        ok = ok & ((hit["t"] <= own + gap) if forward else (hit["t"] >= own - gap))
    return found.select(
        *key,
        *[F.col("__row")[c].alias(c) for c in left.columns if c not in key],
        *[F.when(ok, hit[n]).alias(n) for n in take],
    )

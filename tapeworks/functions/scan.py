"""Ordered scans that never put one whole key, or one global order, into a single task.

The order axis is cut into blocks of bounded size. Every scan is then a window inside
(key, block), one small map-side aggregate per (key, block), and a join of the carried
prefix back on (key, block). The cut points only decide how rows are spread over tasks;
any cut points give the same result, so approximate quantiles are good enough.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, inf

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.session import materialize

BLOCK = "__blk"
ROWS_PER_BLOCK = 1_000_000
SMALL_BLOCK = 4096
_SUB = 65536
_SAMPLE = 20_000


@dataclass(frozen=True)
class Cuts:
    """Cut points of an order axis, plus cuts of the tie-break inside very common values."""

    points: tuple[float, ...] = ()
    ties: tuple[tuple[float, tuple], ...] = field(default=())

    @property
    def single(self) -> bool:
        return not self.points


def axis_value(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        col = F.unix_micros(col.cast("timestamp"))
    elif isinstance(kind, T.TimestampType):
        col = F.unix_micros(col)
    elif isinstance(kind, T.DateType):
        col = F.unix_date(col)
    return col.cast("double")


def order_cuts(
    df: DataFrame,
    order: list[str],
    *,
    rows_per_block: int = ROWS_PER_BLOCK,
    blocks: int | None = None,
) -> Cuts:
    """One column-pruned pass: the row count and an approximate quantile sketch of the axis."""
    axis = axis_value(df, order[0])
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    first = blocks or 512
    probs = [i / first for i in range(1, first)]
    stats = df.select(axis.alias("x")).agg(
        F.count("x").alias("n"),
        F.percentile_approx("x", probs, 5_000).alias("q") if probs else F.lit(None).alias("q"),
    ).first()
    n = stats["n"]
    wanted = blocks or max(ceil(n / rows_per_block), min(parallelism, ceil(n / SMALL_BLOCK)))
    if n == 0 or wanted <= 1:
        return Cuts()
    sketch = stats["q"]
    if not blocks and wanted > 512:
        # as many blocks as the rows need; the sketch is ten times finer than a block
        probs = [i / wanted for i in range(1, wanted)]
        sketch = df.select(axis.alias("x")).agg(
            F.percentile_approx("x", probs, max(100_000, 10 * wanted)).alias("q")
        ).first()["q"]
    if blocks or wanted > 512:
        picked = list(sketch)
    else:
        picked = [sketch[round(i * 512 / wanted) - 1] for i in range(1, wanted)]
    points = sorted(set(picked))
    heavy = sorted({p for p in points if picked.count(p) > 1})
    ties: list[tuple[float, tuple]] = []
    if heavy and len(order) > 1:
        ties = _tie_cuts(df, axis, order[1:], {p: picked.count(p) for p in heavy}, n, wanted)
        # a common value gets a block range of its own: [v, next double)
        points = sorted(set(points) | {v + max(1.0, abs(v)) * 2.0**-52 for v, _ in ties})
    return Cuts(tuple(points), tuple(ties))


def _tie_cuts(df, axis, rest, repeats, n, wanted):
    share = sum(repeats.values()) / wanted
    fraction = min(1.0, _SAMPLE / max(1.0, n * share))
    rows = (
        df.select(axis.alias("x"), *rest)
        .where(F.col("x").isin(list(repeats)))
        .sample(fraction=fraction, seed=7)  # about _SAMPLE rows, from all partitions alike
        .collect()
    )
    out = []
    for value, k in repeats.items():
        seen = sorted(tuple(r[c] for c in rest) for r in rows if r["x"] == value)
        cuts = sorted({seen[len(seen) * i // (k + 1)] for i in range(1, k + 1)}) if seen else []
        out.append((value, tuple(cuts)))
    return out


def with_block(df: DataFrame, order: list[str], cuts: Cuts) -> DataFrame:
    """Add the block number: monotone in the order, looked up by binary search in the JVM."""
    if cuts.single:
        return df.withColumn(BLOCK, F.lit(0).cast("long"))
    axis = "__axis"
    df = df.withColumn(axis, axis_value(df, order[0]))
    found = Bucketizer(
        splits=[-inf, *cuts.points, inf], inputCol=axis, outputCol="__bucket", handleInvalid="keep"
    ).transform(df)
    block = F.col("__bucket").cast("long") * _SUB
    for value, bounds in cuts.ties:
        if not bounds:
            continue
        fields = [df.schema[c].dataType for c in order[1:]]
        here = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(order[1:])])
        table = F.array(*[
            F.struct(*[F.lit(v).cast(t).alias(f"f{i}") for i, (v, t) in enumerate(zip(b, fields))])
            for b in bounds
        ])
        sub = F.size(F.filter(table, lambda b: b <= here))
        block = block + F.when(F.col(axis) == value, sub).otherwise(0)
    return found.withColumn(BLOCK, block).drop(axis, "__bucket")


def block_window(key, order: list[str], descending: bool = False):
    way = F.desc if descending else F.asc
    return Window.partitionBy(*key, BLOCK).orderBy(*[way(c) for c in order])


def running(
    df: DataFrame,
    specs: dict[str, tuple],
    *,
    key=(),
    order: list[str],
    cuts: Cuts | None = None,
    descending: bool = False,
    keep_block: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Running aggregates along `order` inside `key`, without one task per key.

    specs: {out: (kind, column)} or {out: (kind, column, "before")}; kind is one of
    sum, count, max, min, last (last non-null) and lag (previous row's value).
    "before" leaves the current row out. A frame that already has its blocks keeps them, so a
    second scan in the same order needs no new shuffle. `source` may give the same rows in a
    cheaper form for the per-block totals.
    """
    key = list(key)
    cuts = cuts if cuts is not None else order_cuts(df, order)
    blocked = df if BLOCK in df.columns else with_block(df, order, cuts)
    base = block_window(key, order, descending)
    upto = base.rowsBetween(Window.unboundedPreceding, 0)
    before = base.rowsBetween(Window.unboundedPreceding, -1)
    plans = {}
    for out, spec in specs.items():
        kind, col = spec[0], spec[1]
        if kind == "lag":
            plans[out] = ("last", F.struct(col.alias("v")), True, True)
        else:
            plans[out] = (kind, col, len(spec) > 2, False)

    # every running value in one projection, so the windows share one sort
    local = blocked.select(
        "*",
        *[
            _over(kind, col, before if excl else upto).alias(f"__l_{out}")
            for out, (kind, col, excl, _) in plans.items()
        ],
    )
    if not cuts.single:
        at = F.struct(*order)
        total = (source if source is not None else blocked).groupBy(*key, BLOCK).agg(
            *[_total(kind, col, at, descending).alias(f"__t_{o}") for o, (kind, col, _, _) in plans.items()]
        )
        way = F.desc if descending else F.asc
        earlier = Window.partitionBy(*key).orderBy(way(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
        carry = total.select(
            *key,
            BLOCK,
            *[
                _over("sum" if kind == "count" else kind, F.col(f"__t_{o}"), earlier).alias(f"__c_{o}")
                for o, (kind, _, _, _) in plans.items()
            ],
        )
        local = local.join(carry, [*key, BLOCK], "left")
    drop = [BLOCK] if not keep_block else []
    results = {}
    for out, (kind, _, _, wrapped) in plans.items():
        value = F.col(f"__l_{out}")
        drop.append(f"__l_{out}")
        if not cuts.single:
            value = _merge(kind, value, F.col(f"__c_{out}"))
            drop.append(f"__c_{out}")
        elif kind == "count":
            value = F.coalesce(value, F.lit(0))
        results[out] = value["v"] if wrapped else value
    return local.withColumns(results).drop(*drop)


def _over(kind: str, col: Column, w) -> Column:
    if kind == "sum":
        return F.sum(col).over(w)
    if kind == "count":
        return F.count(col).over(w)
    if kind == "max":
        return F.max(col).over(w)
    if kind == "min":
        return F.min(col).over(w)
    if kind == "last":
        return F.last(col, ignorenulls=True).over(w)
    raise ValueError(kind)


def _total(kind: str, col: Column, at: Column, descending: bool) -> Column:
    if kind == "last":
        pick = F.min_by if descending else F.max_by
        return pick(col, F.when(col.isNotNull(), at))
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](col)


def _merge(kind: str, local: Column, carry: Column) -> Column:
    if kind == "count":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if kind == "sum":
        return F.coalesce(local + carry, local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


# Contributions decayed by exp(-200) are far below double resolution, so a term is carried
# over one decay step only; steps keep exp() away from underflow.
_DECAY_STEP = 200.0


def affine(
    df: DataFrame,
    ratio: str,
    terms: dict[str, str],
    *,
    key,
    order: list[str],
    cuts: Cuts,
) -> DataFrame:
    """Solve y_t = ratio_t * y_(t-1) + term_t per key for several non-negative terms at once.

    0 <= ratio <= 1; ratio 0 restarts the recurrence. Inside a block
    y_t = P_t * sum(term_s / P_s) with P the running product of ratios since the restart.
    Adds `<out>` and `<out>_prev` (the value before the row).
    """
    key = list(key)
    blocked = with_block(df, order, cuts)
    base = block_window(key, order)
    upto = base.rowsBetween(Window.unboundedPreceding, 0)
    r = F.col(ratio)
    log_r = F.when(r > 0, F.ln(r)).otherwise(0.0)
    staged = blocked.withColumns({
        "__seg": F.sum(F.when(r == 0, 1).otherwise(0)).over(upto),
        "__lp": F.sum(log_r).over(upto),
    }).withColumn("__step", F.floor(-F.col("__lp") / _DECAY_STEP))
    piece = Window.partitionBy(*key, BLOCK, "__seg", "__step").orderBy(*order)
    piece_upto = piece.rowsBetween(Window.unboundedPreceding, 0)
    staged = staged.withColumn("__lp0", F.first("__lp").over(piece_upto))
    decay = F.exp(F.col("__lp") - F.col("__lp0"))
    staged = staged.withColumns({
        f"__s_{o}": decay * F.sum(F.col(c) / decay).over(piece_upto) for o, c in terms.items()
    })
    # first row of a piece takes over the previous piece of the same segment
    opens = (F.lag("__seg").over(base) == F.col("__seg")) & (F.lag("__step").over(base) != F.col("__step"))
    fresh = F.lag("__seg").over(base).isNull() | (F.lag("__seg").over(base) != F.col("__seg"))
    staged = staged.withColumns({
        f"__i_{o}": F.when(opens, F.lag(f"__s_{o}").over(base) * r).when(fresh, 0.0) for o in terms
    })
    staged = staged.withColumns({
        f"__y_{o}": F.col(f"__s_{o}") + decay * F.last(f"__i_{o}", ignorenulls=True).over(upto)
        for o in terms
    })
    # share of the value before the block that is left at this row
    left = F.when(F.col("__seg") == 0, F.exp(F.col("__lp"))).otherwise(0.0)
    staged = staged.withColumn("__left", left)
    staged = staged.withColumns({
        "__left_prev": F.lag("__left").over(base), **{f"__p_{o}": F.lag(f"__y_{o}").over(base) for o in terms},
    })
    junk = ["__seg", "__lp", "__step", "__lp0", *[f"{p}{o}" for o in terms for p in ("__s_", "__i_")]]
    staged = staged.drop(*junk)
    if cuts.single:
        final = staged.withColumns({o: F.col(f"__y_{o}") for o in terms})
        final = final.withColumns({f"{o}_prev": F.coalesce(f"__p_{o}", F.lit(0.0)) for o in terms})
    else:
        # read twice, for the block ends and for the rows: written once, so one large shuffle
        staged = materialize(staged, "affine")
        at = F.struct(*order)
        ends = staged.groupBy(*key, BLOCK).agg(
            F.max_by(F.struct(F.col("__left").alias("g"), *[F.col(f"__y_{o}").alias(f"y_{o}") for o in terms]), at).alias("e"))
        # the block ends obey the same recurrence: one row per key and block, solved alike
        ends = materialize(ends.select(*key, F.col(BLOCK).alias("__end"), "e.g", *[f"e.y_{o}" for o in terms]), "ends")
        solved = affine(
            ends, "g", {f"__k_{o}": f"y_{o}" for o in terms}, key=key, order=["__end"],
            cuts=order_cuts(ends, ["__end"], rows_per_block=max(SMALL_BLOCK, ROWS_PER_BLOCK // 16)))
        carry = solved.select(*key, F.col("__end").alias(BLOCK), *[F.col(f"__k_{o}_prev").alias(f"__k_{o}") for o in terms])
        final = staged.join(carry, [*key, BLOCK], "left")
        final = final.withColumns({
            **{o: F.col(f"__y_{o}") + F.col("__left") * F.col(f"__k_{o}") for o in terms},
            **{f"{o}_prev": F.coalesce(F.col(f"__p_{o}") + F.col("__left_prev") * F.col(f"__k_{o}"), F.col(f"__k_{o}"))
               for o in terms},
        }).drop(*[f"__k_{o}" for o in terms])
    return final.drop("__left", "__left_prev", BLOCK, *[f"{p}{o}" for o in terms for p in ("__y_", "__p_")])


RANK = "__rank"
FRAME = "__frame"
_OWN = "__own"
ROWS_PER_FRAME = 1_000_000


def framed(
    df: DataFrame,
    *,
    key,
    order: list[str],
    before: int,
    after: int = 0,
    cuts: Cuts | None = None,
    rows: int = ROWS_PER_FRAME,
) -> tuple[DataFrame, object]:
    """Prepare bounded-lookback windows without one task per key.

    Rows are numbered per key and dealt into runs of `rows`; the last `before` rows of a run
    are repeated in the next one (and the first `after` rows in the one before). Returns the
    frame and its window; call `own_rows` after evaluating functions over it.
    """
    key = list(key)
    rows = max(rows, before, after, 1)
    ranked = running(df, {RANK: ("count", F.lit(1))}, key=key, order=order, cuts=cuts)
    zero = F.col(RANK) - 1
    run = F.floor(zero / rows)
    place = zero % rows
    runs = [run]
    if before:
        runs.append(F.when(place >= rows - before, run + 1))
    if after:
        runs.append(F.when((place < after) & (run > 0), run - 1))
    spread = ranked.withColumn(FRAME, F.explode(F.array_compact(F.array(*runs))))
    spread = spread.withColumn(_OWN, F.col(FRAME) == F.floor((F.col(RANK) - 1) / rows))
    return spread, Window.partitionBy(*key, FRAME).orderBy(RANK)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(_OWN)).drop(FRAME, _OWN, RANK)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by keys into the session's full partition count.

    Adaptive execution merges partitions by bytes; work that is heavy per byte, such as model
    fitting, would then run in very few tasks. An explicit count is left alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

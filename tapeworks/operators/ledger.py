"""Fill accounting: signed average-cost positions, round trips, cash, equity, drawdown, FIFO."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.scan import Cuts, affine, order_cuts, running, with_block
from tapeworks.session import materialize

FLAT = 1e-9
INITIAL_CASH = 1000.0
# sums of quantities are exact decimals: a running float sum would drift past FLAT
_QTY = "decimal(28,12)"


def position_inputs(fills: DataFrame, *, key=("instrument",), time="ts", uid="execution_id",
                    cuts: Cuts | None = None) -> DataFrame:
    """Running signed quantity before and after each fill."""
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    exact = signed.cast(_QTY)
    scanned = running(
        fills.withColumn("signed", signed),
        {"__q": ("sum", exact), "last_price_prev": ("lag", F.col("fill_price"))},
        key=key, order=[time, uid], cuts=cuts,
    )

    def snap(x):
        return F.when(F.abs(x) < FLAT, F.lit(0.0)).otherwise(x.cast("double"))

    return scanned.withColumns({
        "qty": snap(F.col("__q")),
        "qty_prev": snap(F.col("__q") - exact),
    }).drop("__q")


def signed_positions(fills: DataFrame, *, key=("instrument",), time="ts", uid="execution_id",
                     cuts: Cuts | None = None) -> DataFrame:
    """Per fill: position, average entry price and carried slippage, before and after it.

    The open cost basis obeys basis_t = r * basis_(t-1) + a: an add has r=1, a partial close
    shrinks by the closed share, going flat or flipping restarts it.
    """
    order = [time, uid]
    cuts = cuts if cuts is not None else order_cuts(fills, order)
    f = position_inputs(fills, key=key, time=time, uid=uid, cuts=cuts)
    q, p, s = F.col("qty"), F.col("qty_prev"), F.col("signed")
    notional = F.col("fill_price") * F.col("quantity")
    slip = F.abs(F.coalesce("slippage_bps", F.lit(0.0))) / 1e4 * notional
    opposes = (p != 0) & (F.signum(p) != F.signum(s))
    flips = opposes & (q != 0) & (F.signum(q) != F.signum(p))
    f = f.withColumns({
        "fill_slippage": slip,
        "opposes": opposes,
        "__r": F.when(p == 0, 0.0).when(~opposes, 1.0).when((q == 0) | flips, 0.0)
        .otherwise(F.abs(q) / F.nullif(F.abs(p), F.lit(0.0))),
        "__basis": F.when(flips, F.col("fill_price") * F.abs(q)).when(opposes, 0.0).otherwise(notional),
        "__slip": F.when(opposes, 0.0).otherwise(slip),
    })
    f = affine(f, "__r", {"basis": "__basis", "open_slippage": "__slip"}, key=key, order=order, cuts=cuts)

    def avg(basis, qty):
        return F.coalesce(F.col(basis) / F.nullif(F.abs(qty), F.lit(0.0)), F.lit(0.0))

    return f.withColumns({
        "avg_cost": avg("basis", q), "avg_cost_prev": avg("basis_prev", p),
    }).drop("__r", "__basis", "__slip", "basis", "basis_prev").withColumns({
        "closed_qty": F.when(opposes, F.least(F.abs(p), F.col("quantity"))).otherwise(0.0),
    }).withColumns({
        "realized": F.signum(p) * (F.col("fill_price") - F.col("avg_cost_prev")) * F.col("closed_qty"),
        "released_slippage": F.when(
            opposes,
            F.col("open_slippage_prev") * F.col("closed_qty") / F.nullif(F.abs(p), F.lit(0.0)) + slip,
        ),
    })


def round_trips(positions: DataFrame, *, time="ts", prorate_flip: bool = False) -> DataFrame:
    """One row per opposing fill. The closing fill's whole fee and slippage count, also when
    it flips the position, unless `prorate_flip` keeps only the closed share."""
    share = F.col("closed_qty") / F.col("quantity") if prorate_flip else F.lit(1.0)
    fee = F.col("transaction_cost") * share
    slip = F.col("released_slippage") - F.col("fill_slippage") * (1 - share)
    keep = [c for c in ("execution_id", "event_id") if c in positions.columns]
    return positions.where("opposes").select(
        "instrument", *keep, F.col("realized").alias("pnl"), fee.alias("fee"), slip.alias("slippage"),
        (F.col("realized") - fee).alias("net_pnl"), "closed_qty", F.col(time).alias("time"),
    )


def cash_ledger(positions: DataFrame, *, initial_cash: float = INITIAL_CASH, time="ts",
                uid="execution_id", cuts: Cuts | None = None) -> DataFrame:
    """Cash after each fill, over all instruments in one order."""
    flow = -(F.col("signed") * F.col("fill_price")) - F.col("transaction_cost")
    out = running(positions, {"__cash": ("sum", flow)}, order=[time, uid], cuts=cuts)
    return out.withColumn("cash", F.col("__cash") + initial_cash).drop("__cash")


def equity_curve(positions: DataFrame, *, initial_cash: float = INITIAL_CASH, mark_to_market: bool = False,
                 time="ts", uid="execution_id", cuts: Cuts | None = None) -> DataFrame:
    """Account value after each fill: cash plus signed positions at average cost or last price.

    Only the filled instrument's value changes, so the account is one running sum of deltas.
    """
    now, before = ("fill_price", "last_price_prev") if mark_to_market else ("avg_cost", "avg_cost_prev")
    flow = -(F.col("signed") * F.col("fill_price")) - F.col("transaction_cost")
    delta = F.col("qty") * F.col(now) - F.col("qty_prev") * F.coalesce(before, F.lit(0.0))
    scanned = running(
        positions.select(
            "instrument", time, uid, flow.alias("__flow"), (flow + delta).alias("__step"),
            "realized", "transaction_cost",
        ),
        {
            "__cash": ("sum", F.col("__flow")), "__value": ("sum", F.col("__step")),
            "pnl": ("sum", F.col("realized")), "fees": ("sum", F.col("transaction_cost")),
            "fills": ("count", F.lit(1)),
        },
        order=[time, uid], cuts=cuts,
    )
    return scanned.select(
        time, uid, "instrument",
        (F.col("__value") + initial_cash).alias("value"), (F.col("__cash") + initial_cash).alias("cash"),
        "pnl", "fees", "fills", (F.col("realized") - F.col("transaction_cost")).alias("change"),
    )


DRAWDOWN_START = 1e-4


def drawdown_points(equity: DataFrame, *, initial_cash: float = INITIAL_CASH, time="ts",
                    uid="execution_id", cuts: Cuts | None = None) -> DataFrame:
    """Running peak (never below the initial cash), drawdown and its share of the peak."""
    e = running(
        equity, {"__p": ("max", F.col("value")), "__before": ("max", F.col("value"), "before")},
        order=[time, uid], cuts=cuts,
    )
    peak = F.greatest(F.col("__p"), F.lit(initial_cash))
    before = F.greatest(F.coalesce("__before", F.lit(initial_cash)), F.lit(initial_cash))
    dd = peak - F.col("value")
    return e.withColumns({
        "peak": peak, "new_peak": F.col("value") > before, "drawdown": dd,
        "drawdown_pct": F.when(peak > 0, dd / F.nullif(peak, F.lit(0.0))).otherwise(0.0),
    }).drop("__p", "__before")


def drawdown_summary(points: DataFrame, *, as_of, time="ts", uid="execution_id") -> DataFrame:
    """Worst drawdown, longest recovered one and the age of the open one, up to as_of.

    Peaks only rise, so the peak value names the island between two new peaks.
    """
    asof = F.lit(as_of).cast("timestamp")
    islands = points.where(F.col(time) <= asof).groupBy("peak").agg(
        F.min(F.struct(time, uid)).alias("first"),
        F.min(F.when(F.col("drawdown_pct") > DRAWDOWN_START, F.col(time))).alias("dd_start"),
        F.max(F.struct("drawdown_pct", "drawdown")).alias("worst"),
    ).select("peak", F.col("first")[time].alias("t"), "dd_start", "worst")
    # the island after this one starts with the recovery
    linked = running(islands, {"recovered": ("lag", F.col("t"))}, order=["peak"], descending=True)
    length = F.unix_micros("recovered") / 1e6 - F.unix_micros("dd_start") / 1e6
    open_len = F.unix_micros(asof) / 1e6 - F.unix_micros("dd_start") / 1e6
    return linked.agg(
        F.max("worst").alias("w"),
        F.coalesce(F.max(F.when(length > 0, length)), F.lit(0.0)).alias("max_dd_duration_secs"),
        F.coalesce(F.max(F.when(F.col("recovered").isNull(), open_len)), F.lit(0.0)).alias("current_dd_duration_secs"),
    ).select(
        F.col("w.drawdown").alias("max_drawdown"), F.col("w.drawdown_pct").alias("max_drawdown_pct"),
        "max_dd_duration_secs", "current_dd_duration_secs",
    )


def unrealized(positions: DataFrame) -> DataFrame:
    """Signed market value and open profit of each row's position at the row's own price."""
    return positions.withColumns({
        "market_value": F.col("qty") * F.col("fill_price"),
        "unrealized": F.col("qty") * (F.col("fill_price") - F.col("avg_cost")),
    })


def last_prices(fills: DataFrame, *, time="ts", uid="execution_id") -> DataFrame:
    return fills.groupBy("instrument").agg(F.max_by("fill_price", F.struct(time, uid)).alias("last_price"))


def open_positions(positions: DataFrame, *, time="ts", uid="execution_id") -> DataFrame:
    """The latest position of each instrument."""
    return positions.groupBy("instrument").agg(
        F.max_by(F.struct("qty", "avg_cost", "fill_price"), F.struct(time, uid)).alias("p"),
        F.count("*").alias("fills"),
    ).select(
        "instrument", "fills", F.col("p.qty").alias("position"), F.col("p.avg_cost").alias("avg_cost"),
        F.col("p.fill_price").alias("last_price"),
    )


def recent(df: DataFrame, n: int, *, time="time", uid="execution_id") -> DataFrame:
    """The newest n rows, newest first."""
    return df.orderBy(F.desc(time), F.desc(uid)).limit(n)


MATCH_EPSILON = 1e-12


def fifo_match(fills: DataFrame, *, key=("instrument",), time="ts", uid="execution_id",
               cuts: Cuts | None = None) -> DataFrame:
    """Pair opening and closing quantity first-in first-out, both directions, partial fills.

    The k-th unit bought always meets the k-th unit sold, so both sides are laid on one axis
    of cumulative quantity and every stretch between two breakpoints is one match.
    """
    key = list(key)
    side = F.when(F.col("side") == "BUY", 0).otherwise(1)
    cuts = cuts if cuts is not None else order_cuts(fills, [time, uid])
    sided = fills.select(
        *key, side.alias("__side"),
        F.struct(F.col(uid).alias("id"), F.col(time).alias("t"), F.col("fill_price").alias("price"),
                 F.col("quantity").alias("qty"), F.col("transaction_cost").alias("fee")).alias("__fill"),
        F.col("quantity").cast(_QTY).alias("__n"), F.col(time).alias("__t"), F.col(uid).alias("__u"),
    )
    ends = running(sided, {"__end": ("sum", F.col("__n"))}, key=[*key, "__side"], order=["__t", "__u"], cuts=cuts)
    at = ["__end", "__side", "__u"]
    # read for the cuts, the block totals of both directions, and the rows: written once
    ends = materialize(ends, "fifo")
    axis = order_cuts(ends, at)
    ends = with_block(ends, at, axis)
    # what is being bought and sold just before a breakpoint is the next breakpoint of each side
    nexts = running(
        ends,
        {
            "buy": ("last", F.when(F.col("__side") == 0, F.col("__fill"))),
            "sell": ("last", F.when(F.col("__side") == 1, F.col("__fill"))),
        },
        key=key, order=at, cuts=axis, descending=True, keep_block=True,
    )
    cut = running(nexts, {"__from": ("lag", F.col("__end"))}, key=key, order=at, cuts=axis, source=ends)
    size = F.col("__end") - F.coalesce(F.col("__from"), F.lit(0).cast(_QTY))
    buy_first = F.struct(F.col("buy.t"), F.col("buy.id")) < F.struct(F.col("sell.t"), F.col("sell.id"))
    entry = F.when(buy_first, F.col("buy")).otherwise(F.col("sell"))
    exit_ = F.when(buy_first, F.col("sell")).otherwise(F.col("buy"))
    m = cut.where(F.col("buy").isNotNull() & F.col("sell").isNotNull() & (size > MATCH_EPSILON)).select(
        *key, size.cast("double").alias("qty"), entry.alias("e"), exit_.alias("x"),
        F.when(buy_first, 1.0).otherwise(-1.0).alias("way"),
    )
    entry_fee = F.col("e.fee") * F.col("qty") / F.col("e.qty")
    exit_fee = F.col("x.fee") * F.col("qty") / F.col("x.qty")
    gross = F.col("way") * (F.col("x.price") - F.col("e.price")) * F.col("qty")
    return m.select(
        *key, F.col("e.id").alias("entry_id"), F.col("x.id").alias("exit_id"),
        F.when(F.col("way") > 0, "LONG").otherwise("SHORT").alias("direction"), "qty",
        F.col("e.qty").alias("entry_qty"), F.col("e.price").alias("entry_price"),
        F.col("x.price").alias("exit_price"), F.col("e.t").alias("entry_time"),
        F.col("x.t").alias("exit_time"), entry_fee.alias("entry_fee"), exit_fee.alias("exit_fee"),
        (gross - entry_fee - exit_fee).alias("pnl"),
    )


def fifo_labels(matches: DataFrame, *, key=("instrument",)) -> DataFrame:
    """Label entry lots that are closed in full: 1 when their total profit is positive.

    A fill that closes one side and opens the other has only its leftover as the opened lot,
    so closure is checked against the opened quantity.
    """
    key = list(key)
    closed_by = matches.groupBy(*key, F.col("exit_id").alias("entry_id")).agg(
        F.sum(F.col("qty").cast(_QTY)).alias("used")
    )
    lots = matches.groupBy(*key, "entry_id").agg(
        F.sum(F.col("qty").cast(_QTY)).alias("matched"), F.first("entry_qty").alias("entry_qty"),
        F.sum("pnl").alias("pnl"), F.max("exit_time").alias("label_time"),
        F.first("entry_time").alias("entry_time"), F.first("direction").alias("direction"),
    )
    opened = F.col("entry_qty").cast(_QTY) - F.coalesce(F.col("used"), F.lit(0).cast(_QTY))
    return (
        lots.join(closed_by, [*key, "entry_id"], "left")
        .where(F.abs(opened - F.col("matched")) <= MATCH_EPSILON)
        .select(
            *key, "entry_id", "direction", F.col("matched").cast("double").alias("qty"), "pnl",
            (F.col("pnl") > 0).cast("int").alias("label"), "entry_time", "label_time",
        )
    )

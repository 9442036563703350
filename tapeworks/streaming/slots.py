"""Ordered folds over a stream: rows wait by (key, time slot), sealed slots go through the batch
operators, and a row per key carries the state on.

Spark's state store holds the waiting rows of a slot, not those of a key; a slot is released once
the watermark has passed its end. What one micro-batch releases is later than all that was
released before, so an operator that starts from the carried state gives the batch answer, and
inside it blocks of one key run in many tasks. Output and carried state of a micro-batch are
folders named after it: a repeated batch overwrites its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tapeworks.functions.asof import asof_join
from tapeworks.functions.scan import Cuts, order_cuts
from tapeworks.operators.ledger import signed_positions
from tapeworks.operators.regime import DIMS, MODEL, causal_filter
from tapeworks.session import materialize

SLOT = "15 minutes"
PARTS = 8
#: Rows that one task per key folds without cutting the time axis first.
SINGLE = 200_000

#: (rows of a micro-batch, carried state or None, whether the rows are few) -> (output, the written output to the state to carry)
Step = Callable[[DataFrame, DataFrame | None, bool], tuple[DataFrame, Callable[[DataFrame], DataFrame]]]


def sealed(stream: DataFrame, cols: list[str], *, key: str, time: str, uid: str, delay: str | None, slot: str = SLOT, parts: int = PARTS) -> DataFrame:
    """(key, slot, part, rows): the rows of each slot, once the watermark has passed its end.

    A slot of a key is dealt into parts by a hash of the id, so a busy one is several entries.
    Without a delay the stream has its watermarks already.
    """
    part = F.pmod(F.xxhash64(uid), F.lit(parts)).alias("part")
    marked = stream.select(key, *cols, part)
    marked = marked.withWatermark(time, delay) if delay else marked
    return marked.groupBy(key, F.window(time, slot).alias("slot"), "part").agg(F.collect_list(F.struct(*cols)).alias("rows"))


def carried(path: str, step: Step) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over `sealed`: output to path/rows/batch=N, state to path/carry/batch=N.

    Batch N starts from the state of batch N - 1 and leaves a state even where it has no rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = Observation()
        rows = batch.select(batch.columns[0], F.explode("rows").alias("r")).select(batch.columns[0], "r.*")
        rows = materialize(rows.observe(seen, F.count(F.lit(1)).alias("n")), "sealed")
        before = spark.read.parquet(f"{path}/carry/batch={batch_id - 1}") if batch_id else None
        n = seen.get["n"]
        if not n and before is not None:
            before.write.mode("overwrite").parquet(f"{path}/carry/batch={batch_id}")
            return
        out, after = step(rows, before, n <= SINGLE)
        out.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        after(spark.read.schema(out.schema).parquet(f"{path}/rows/batch={batch_id}")).write.mode("overwrite").parquet(f"{path}/carry/batch={batch_id}")

    return write


def _cuts(rows: DataFrame, order: list[str], few: bool) -> Cuts:
    return Cuts() if few else order_cuts(rows, order)


def _newest(out: DataFrame, before: DataFrame | None, state: list[str], time: str, uid: str) -> DataFrame:
    """The state after the last row of each key, or the one carried so far."""
    cols = ["instrument", time, uid, *state]
    rows = out.select(*cols) if before is None else out.select(*cols).unionByName(before.select(*cols))
    last = rows.groupBy("instrument").agg(F.max_by(F.struct(time, uid, *state), F.struct(time, uid)).alias("s"))
    return last.select("instrument", "s.*")


FILL = ["execution_id", "ts", "side", "quantity", "fill_price", "slippage_bps"]
POSITION = ["qty", "avg_cost", "open_slippage"]


def positions_step(rows: DataFrame, before: DataFrame | None, few: bool):
    """The ledger's rows of a micro-batch. The carried position comes in as one opening fill at its
    average cost, which leaves the ledger in exactly that state, and goes out again."""
    rows = rows.withColumn("opening", F.lit(False))
    if before is not None:
        size = F.abs("qty")
        opening = before.where("qty <> 0").select(
            "instrument", "execution_id", "ts", F.when(F.col("qty") > 0, "BUY").otherwise("SELL").alias("side"), size.alias("quantity"),
            F.col("avg_cost").alias("fill_price"), (F.col("open_slippage") / F.nullif(size * F.col("avg_cost"), F.lit(0.0)) * 1e4).alias("slippage_bps"),
            F.lit(True).alias("opening"))
        rows = rows.unionByName(opening)
    ledger = signed_positions(rows, cuts=_cuts(rows, ["ts", "execution_id"], few)).where("not opening")
    out = ledger.select("instrument", "execution_id", "ts", *POSITION, "realized", "opposes")
    return out, lambda done: _newest(done, before, POSITION, "ts", "execution_id")


def positions(fills: DataFrame, *, delay: str = "1 hour", **slots) -> DataFrame:
    """Sealed fills; write them with carried(path, positions_step)."""
    return sealed(fills, FILL, key="instrument", time="ts", uid="execution_id", delay=delay, **slots)


def regimes_step(models: DataFrame) -> Step:
    """Filtered states of a micro-batch. The chain goes on from the last probabilities p of a key:
    its first row then meets p times the transitions where a new chain would meet pi."""
    def step(rows: DataFrame, before: DataFrame | None, few: bool):
        own = models.select("instrument", *MODEL)
        if before is not None:
            k = F.size("pi")
            moved = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.aggregate(
                F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda t, i: t + F.col("probs")[i] * F.col("trans")[i * k + j]))
            own = own.join(before.select("instrument", "probs"), "instrument", "left").withColumn(
                "pi", F.when(F.col("probs").isNull(), F.col("pi")).otherwise(moved)).drop("probs")
        out = causal_filter(rows, own, cuts=_cuts(rows, ["event_time", "event_id"], few))
        return out, lambda done: _newest(done.where("probs is not null"), before, ["probs"], "event_time", "event_id")

    return step


def regimes(obs: DataFrame, *, delay: str = "1 hour", **slots) -> DataFrame:
    """Sealed observations; write them with carried(path, regimes_step(models))."""
    return sealed(obs, ["event_id", "event_time", *DIMS], key="instrument", time="event_time", uid="event_id", delay=delay, **slots)


def arrivals_step(tolerance: str) -> Step:
    """Fills of a micro-batch with the last tick inside the tolerance. The last tick of each key goes
    on, as no earlier one can be newer; equal fills are one, and a key that is NULL has no ticks."""
    def step(rows: DataFrame, before: DataFrame | None, few: bool):
        ticks = rows.where("tick is not null and instrument is not null").select("instrument", "ts", "tick.*")
        if before is not None:
            ticks = ticks.unionByName(before.select(*ticks.columns))
        uid = F.coalesce(F.col("tick.tick_id").cast("string"), F.col("uid").cast("string"))
        order = rows.select("ts", F.col("tick").isNull().cast("int").alias("side"), uid.alias("uid"))
        joined = asof_join(
            rows.where("fill is not null").select("instrument", "ts", "uid", "fill"), ticks, left_time="ts", right_time="ts",
            left_uid="uid", right_uid="tick_id", take={"arrival": "price"}, tolerance=tolerance, cuts=_cuts(order, ["ts", "side", "uid"], few))
        return joined.select("fill.*", "ts", "arrival").dropDuplicates(), lambda done: _newest(ticks, None, ["price"], "ts", "tick_id")

    return step


def arrivals(fills: DataFrame, ticks: DataFrame, *, delay: str = "10 minutes", **slots) -> DataFrame:
    """Sealed fills and ticks, each behind the slower one's watermark; write them with carried(path, arrivals_step(tolerance))."""
    rest = [c for c in fills.columns if c != "ts"]
    f = fills.withWatermark("ts", delay).select(
        "instrument", "ts", F.xxhash64(*rest).alias("uid"), F.struct(*rest).alias("fill"), F.lit(None).alias("tick"))
    t = ticks.withWatermark("ts", delay).select(
        "instrument", "ts", F.xxhash64("tick_id").alias("uid"), F.lit(None).alias("fill"), F.struct("price", "tick_id").alias("tick"))
    return sealed(f.unionByName(t), ["ts", "uid", "fill", "tick"], key="instrument", time="ts", uid="uid", delay=None, **slots)

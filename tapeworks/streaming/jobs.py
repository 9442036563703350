"""Streaming forms of the operators. Batch and stream give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators import bars as bar_ops
from tapeworks.operators.decisions import decide
from tapeworks.operators.quality import fill_key
from tapeworks.operators.store import append_indexed
from tapeworks.streaming import slots

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    # a batch writes what it changed, not the whole table
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def dedup_stream(fills: DataFrame, *, time="ts", delay: str = "1 hour") -> DataFrame:
    """First copy of each fill; a key is remembered until the watermark passes it."""
    return fills.withColumn("fill_key", fill_key(fills)).withWatermark(time, delay).dropDuplicatesWithinWatermark(
        ["fill_key"]).drop("fill_key")


def bars_stream(ticks: DataFrame, width: str = "5 minutes", *, time="ts", uid="tick_id", delay: str = "10 minutes") -> DataFrame:
    return bar_ops.bars(ticks.withWatermark(time, delay), width, time=time, uid=uid)


def vwap_stream(ticks: DataFrame, width: str = "1 minute", *, time="ts", delay: str = "10 minutes") -> DataFrame:
    return bar_ops.vwap(ticks.withWatermark(time, delay), width, time=time)


def decisions_stream(features: DataFrame, **params) -> DataFrame:
    return decide(features, **params)


def sessions_stream(events: DataFrame, *, key=("job",), time="ts", gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Stretches of activity separated by silence longer than `gap`."""
    return events.withWatermark(time, delay).groupBy(*key, F.session_window(time, gap).alias("s")).agg(
        F.count("*").alias("events"), F.max(time).alias("last_event")
    ).select(*key, F.col("s.start").alias("session_start"), "last_event", "events")


def tca_stream(fills: DataFrame, ticks: DataFrame, *, tolerance_secs: int = 60, delay: str = "10 minutes") -> tuple[DataFrame, slots.Step]:
    """Fills with the last tick inside the tolerance: a sealed stream and its step, for slots.carried.

    Fills and ticks wait by time slot and meet in one pass in time order, so a fill is not paired
    with every tick of its last minute. Both wait for the slower stream's watermark; a fill
    without a tick keeps a NULL arrival.
    """
    return slots.arrivals(fills, ticks, delay=delay), slots.arrivals_step(f"{tolerance_secs} seconds")


def store_writer(spark: SparkSession, path: str, *, late_path: str | None = None, late_after: str = "1 day"):
    """foreachBatch function: stamps arrival once and appends what the store does not hold.

    Repeating a batch after a failure adds nothing. Very late rows are also copied aside.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if "ingest_time" in batch.columns else batch.withColumn("ingest_time", F.current_timestamp())
        append_indexed(rows, path, batch_id)
        if late_path:
            late = rows.where(F.col("ingest_time") > F.col("event_time") + F.expr(f"interval {late_after}"))
            late.write.mode("append").parquet(late_path)
    return write


def dead_letter_writer(good_path: str, bad_path: str, schema, topic: str):
    """foreachBatch function: decoded records one way, undecodable ones with their raw text the other."""
    from tapeworks.sources.readers import dead_letters, decode, good_records

    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = decode(batch, schema)
        # a folder per batch number, so a repeated batch overwrites its own output
        good_records(decoded).write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        dead_letters(decoded, topic).write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")
    return write

"""Registered queries: the streaming forms, run to the end of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.plans import views
from tapeworks.plans.models import models
from tapeworks.plans.registry import pick, query
from tapeworks.operators import regime
from tapeworks.session import durable_dir, materialize
from tapeworks.streaming import jobs, late_rows, slots


def _in_turn(spark: SparkSession, path: str) -> None:
    """A file source takes files by their age: give those of each slice the age of their turn."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(hadoop.Path(f"{path}/slice=*/*.parquet")):
        turn = int(status.getPath().getParent().getName().split("=")[1])
        fs.setTimes(status.getPath(), 1_000_000_000_000 + 60_000 * turn, -1)


def source(spark: SparkSession, sf: str, view, *, close: str | None = None, closings: int = 1, files: int = 4, slices: int = 1, turn=None) -> DataFrame:
    """A file stream over what a view derives from the tables, in several micro-batches.

    `close` names the event time: a last row, empty but for a time a day after all others,
    moves the watermark past every open window, as the end of a topic does. It stands in
    windows of its own that never close, so no output holds it. A chain of stateful operators
    needs a batch for each, so more `closings`, a day apart. With `slices` the rows come in
    event-time order, a slice of the time axis to a batch; `turn`, a column of numbers from 0,
    names the batch of each row instead, one file each.
    """
    path = f"{durable_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = view(spark, sf)
    if turn is not None:
        rows.withColumn("slice", turn).repartition("slice").write.partitionBy("slice").parquet(path)
        _in_turn(spark, path)
    elif slices == 1:
        rows.repartition(files).write.parquet(f"{path}/slice=0")
    else:
        rows = materialize(rows, "stream-rows")
        at = F.unix_micros(close)
        cuts = rows.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 1000).alias("q")).first()["q"] or []
        place = sum((F.when(at > c, 1).otherwise(0) for c in cuts), F.lit(0))
        piece = F.pmod(F.xxhash64(at), F.lit(files))
        rows.withColumn("slice", place).repartition(files * slices, "slice", piece).write.partitionBy("slice").parquet(path)
        _in_turn(spark, path)
    if close:
        last = spark.read.schema(rows.schema).parquet(f"{path}/*").agg(F.max(close).alias("t")).first()["t"]
        for day in range(1, closings + 1):
            t = F.lit(last) + F.expr(f"interval {day} days")
            # blank text, as a join drops rows without a key before they move the watermark
            blank = [F.lit("" if f.dataType.simpleString() == "string" else None).cast(f.dataType).alias(f.name) for f in rows.schema]
            spark.range(1).select(*[t.alias(f.name) if f.name == close else b for f, b in zip(rows.schema, blank)]
                                  ).coalesce(1).write.parquet(f"{path}/slice={1_000_000 + day}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")


def fold(stream: DataFrame, step: slots.Step) -> DataFrame:
    """Run a sealed stream through its step to the end and return all its rows."""
    spark = stream.sparkSession
    path = f"{durable_dir(spark)}/fold-{uuid.uuid4().hex}"
    drain(stream, each_batch=slots.carried(path, step))
    return spark.read.parquet(f"{path}/rows").drop("batch")


def drain(stream: DataFrame, *, each_batch=None, mode: str = "append") -> DataFrame:
    """Run a stream over all available input and return what it wrote."""
    spark = stream.sparkSession
    jobs.use_rocksdb(spark)
    base = f"{durable_dir(spark)}/drain-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if each_batch:
        writer.foreachBatch(each_batch).start().awaitTermination()
        return None
    writer.format("parquet").outputMode(mode).option("path", f"{base}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("io7_tail_and_resume", """
SELECT CASE WHEN k = 99 THEN '{bad' WHEN k = 98 THEN '[1,2]' END AS raw, CASE WHEN k < 98 THEN epoch_us(ingest_time) END AS ingest_us FROM x_feat""")
def io7(spark, sf):
    """Tail a topic of JSON lines with a durable checkpoint, stop, resume: nothing is read twice."""
    from tapeworks.sources import readers, schemas
    base = f"{durable_dir(spark)}/tail-{uuid.uuid4().hex}"
    write = jobs.dead_letter_writer(f"{base}/good", f"{base}/bad", schemas.RAW_FEATURE, "features")
    lines = views.raw_feature_json(spark, sf)
    for early in (True, False):
        part = lines.where((F.col("seq") < 500) if early else (F.col("seq") >= 500)).select("value")
        part.write.mode("append").text(f"{base}/topic")
        topic = readers.read_records(spark, f"{base}/topic", stream=True)
        topic.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(
            write).start().awaitTermination()
    at = F.unix_micros(F.to_timestamp("ingestTime")).alias("ingest_us")
    good = spark.read.parquet(f"{base}/good").select(F.lit(None).cast("string").alias("raw"), at)
    bad = spark.read.parquet(f"{base}/bad").select("raw", F.lit(None).cast("long").alias("ingest_us"))
    return good.unionByName(bad)


@query("s1_stream_dedup", """
SELECT execution_id, count(*) AS n FROM (SELECT DISTINCT coalesce(nullif(trim(execution_id), ''),
  concat_ws('|', order_id, ts, side, quantity, fill_price)) AS k, nullif(trim(execution_id), '') AS execution_id FROM x_checked WHERE reason IS NULL)
GROUP BY execution_id""")
def s1(spark, sf):
    from tapeworks.operators.quality import typed_fills
    src = source(spark, sf, lambda s, d: typed_fills(views.validated_fills(s, d)))
    return drain(jobs.dedup_stream(src)).groupBy("execution_id").agg(F.count("*").alias("n"))


@query("s2_stream_bars", """
SELECT instrument, epoch_us(open_time) AS open_us, snap(open, 6) AS open, snap(close, 6) AS close, volume, ticks FROM x_bars5""")
def s2(spark, sf):
    return drain(jobs.bars_stream(source(spark, sf, views.trade_ticks, close="ts"))).transform(
        pick, "instrument", "unix_micros(open_time) open_us", "snap(open, 6) open", "snap(close, 6) close", "volume", "ticks")


@query("s2_bars_with_late_rows", """
SELECT instrument, count(*) FILTER (NOT late) AS kept, count(*) FILTER (late) AS late, count(DISTINCT CASE WHEN NOT late THEN time_bucket(INTERVAL 5 MINUTE, ts) END) AS bars FROM (
  SELECT instrument, ts, coalesce(ts < mark - INTERVAL 10 MINUTE, false) AS late FROM x_turns LEFT JOIN x_marks USING (turn)) GROUP BY instrument""")
def s2late(spark, sf):
    """Ticks of which every 17th comes three batches late: bars of those in time, the others kept aside."""
    view = lambda s, d: views.trade_ticks(s, d).withColumn("event_id", F.col("event_id").cast("long"))
    late = F.when(F.col("event_id") % 17 == 0, 3).otherwise(0)
    day = F.datediff("ts", F.lit("2024-01-01")) / 4
    base = f"{durable_dir(spark)}/late-{uuid.uuid4().hex}"
    src = source(spark, sf, view, close="ts", files=1, turn=(F.floor(day) + late).cast("int"))
    drain(src, each_batch=late_rows.aside(base, jobs.bars_stream, time="ts", delay="10 minutes"))
    kept = spark.read.parquet(f"{base}/out").groupBy("instrument").agg(F.sum("ticks").alias("kept"), F.count("*").alias("bars"))
    lost = late_rows.late(spark, base).groupBy("instrument").agg(F.count("*").alias("late"))
    return kept.join(lost, "instrument", "full").select("instrument", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("late", F.lit(0)).alias("late"), F.coalesce("bars", F.lit(0)).alias("bars"))


@query("s3_stream_positions", """
SELECT execution_id, qn AS qty, snap(an, 6) AS avg_cost, snap(sn, 6) AS open_slippage, snap(realized, 6) AS realized FROM x_pos""")
def s3(spark, sf):
    return fold(slots.positions(source(spark, sf, views.fills, close="ts", files=2, slices=8)), slots.positions_step).transform(
        pick, "execution_id", "qty", "snap(avg_cost, 6) avg_cost", "snap(open_slippage, 6) open_slippage", "snap(realized, 6) realized")


@query("s4_stream_store", "SELECT event_id, epoch_us(event_time) AS event_us FROM x_rev")
def s4(spark, sf):
    path = f"{durable_dir(spark)}/store-{uuid.uuid4().hex}"
    drain(source(spark, sf, views.revisions), each_batch=jobs.store_writer(spark, path))
    return spark.read.parquet(path).select("event_id", F.unix_micros("event_time").alias("event_us"))


@query("s5_stream_decisions", "SELECT event_id, type, blocked_by FROM x_dec")
def s5(spark, sf):
    return drain(jobs.decisions_stream(source(spark, sf, views.features))).select("event_id", "type", "blocked_by")


@query("s6_stream_tca", """
SELECT execution_id, snap(arrival, 6) AS arrival FROM x_arrival""")
def s6(spark, sf):
    out = fold(*jobs.tca_stream(*[source(spark, sf, v, close="ts") for v in (views.fills, views.ticks)]))
    return out.where("execution_id <> ''").transform(pick, "execution_id", "snap(arrival, 6) arrival")


@query("s7_stream_regimes", "SELECT instrument, event_id, snap(p0, 5) AS p0, snap(p1, 5) AS p1, snap(p2, 5) AS p2 FROM x_hall")
def s7(spark, sf):
    src = source(spark, sf, lambda s, d: regime.observations(views.features(s, d)), close="event_time", files=2, slices=8)
    return fold(slots.regimes(src), slots.regimes_step(models(spark, sf))).transform(
        pick, "instrument", "event_id", "snap(probs[0], 5) p0", "snap(probs[1], 5) p1", "snap(probs[2], 5) p2")


@query("s8_stream_sessions", """
SELECT job, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM (
  SELECT *, sum(CASE WHEN ts - p < INTERVAL 5 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY job ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, lag(ts) OVER (PARTITION BY job ORDER BY ts, event_id) AS p FROM x_lat)) GROUP BY job, s""")
def s8(spark, sf):
    return drain(jobs.sessions_stream(source(spark, sf, views.latency, close="ts"))).select(
        "job", F.unix_micros("session_start").alias("start_us"), F.unix_micros("last_event").alias("last_us"), "events")

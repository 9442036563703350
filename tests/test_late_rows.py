"""Rows that come after the watermark: kept + late = all, for bars, sessions, deduplication."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import bars
from tapeworks.plans.streams import drain
from tapeworks.session import durable_dir
from tapeworks.streaming import jobs, late_rows

START = datetime(2024, 1, 1)
SCHEMA = "tick_id string, instrument string, price double, quantity double, ts timestamp"


def batches():
    """Six batches of an hour each; some rows come two batches late, some a few minutes."""
    out = [[] for _ in range(8)]
    for i in range(360):
        at = START + timedelta(minutes=i)
        out[i // 60 + (2 if i % 20 == 7 else 1 if i % 60 == 59 else 0)].append((f"t{i}", "AB"[i % 2], 100.0 + i % 9, 1.0, at))
    return [b for b in out if b] + [[("end", "Z", 1.0, 1.0, START + timedelta(days=5))]]


@pytest.fixture(scope="module")
def feed(spark):
    path = f"{durable_dir(spark)}/late-feed-{uuid.uuid4().hex}"
    for b in batches():
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def expected():
    """Late ids by the rule, row by row."""
    top, gone = None, set()
    for b in batches():
        gone |= {r[0] for r in b if top and r[4] < top - timedelta(minutes=10)}
        top = max([r[4] for r in b] + ([top] if top else []))
    return gone


def run(spark, stream, build, fail=()):
    base = f"{durable_dir(spark)}/late-{uuid.uuid4().hex}"
    write = late_rows.aside(base, build, time="ts", delay="10 minutes")

    def each(batch, n):
        write(batch, n)
        if n in fail:
            write(batch, n)  # repeated as after a failure

    drain(stream, each_batch=each)
    return base


def test_bars(spark, feed):
    base = run(spark, feed(), jobs.bars_stream, fail=(1, 3))
    gone = {r.tick_id for r in late_rows.late(spark, base).collect()}
    assert gone == expected() and 10 < len(gone) < 30
    split = spark.read.parquet(f"{base}/split")
    assert split.count() == 361 == split.select("tick_id").distinct().count()  # kept + late = all
    rows = spark.createDataFrame([r for b in batches() for r in b if r[0] not in gone and r[0] != "end"], SCHEMA)
    key = lambda df: sorted((r.instrument, r.open_time, r.open, r.close, r.volume, r.ticks) for r in df.collect())
    assert key(spark.read.parquet(f"{base}/out")) == key(bars.bars(rows))


@pytest.mark.parametrize("kind", ["dedup", "sessions"])
def test_other_operators(spark, feed, kind):
    builds = {
        "dedup": lambda s: s.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["tick_id"]),
        "sessions": lambda s: jobs.sessions_stream(s, key=("instrument",), gap="3 minutes"),
    }
    base = run(spark, feed(), builds[kind])
    gone = {r.tick_id for r in late_rows.late(spark, base).collect()}
    out = spark.read.parquet(f"{base}/out")
    assert gone == expected()
    if kind == "dedup":
        assert out.where("tick_id <> 'end'").count() == 360 - len(gone)
    else:
        assert out.where("instrument <> 'Z'").agg(F.sum("events")).first()[0] == 360 - len(gone)

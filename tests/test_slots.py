"""Sliced streams: many micro-batches, shuffled files, repeated batches; equal to the batch answer."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_market import chain_frame, sample_chain

from tapeworks.operators import regime, tca
from tapeworks.operators.ledger import signed_positions
from tapeworks.plans import views
from tapeworks.plans.streams import drain
from tapeworks.session import durable_dir
from tapeworks.streaming import jobs, slots


def feed(spark, df, time, files, shuffle=0):
    """A file stream of `files` batches in time order; `shuffle` mixes rows of that many batches."""
    path = f"{durable_dir(spark)}/feed-{uuid.uuid4().hex}"
    rows = df.toPandas().sort_values(time, kind="stable").reset_index(drop=True)
    at = np.arange(len(rows)) / len(rows) * files
    if shuffle:
        at = np.clip(at + np.random.default_rng(1).uniform(-shuffle, shuffle, len(rows)), 0, files - 1e-9)
    for i in range(files):
        spark.createDataFrame(rows[at.astype(int) == i], df.schema).coalesce(1).write.mode("append").parquet(path)
    last = [rows[time].max().to_pydatetime() + pd.Timedelta(days=99) if f.name == time else "" if f.dataType.simpleString() == "string" else None for f in df.schema]
    spark.createDataFrame([last], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def folded(spark, stream, step):
    path = f"{durable_dir(spark)}/fold-{uuid.uuid4().hex}"
    batches = []
    write = slots.carried(path, step)

    def each(batch, n):
        write(batch, n)
        if n % 3 == 1:
            write(batch, n)  # a batch repeated after a failure replaces its own output
        batches.append(n)

    drain(stream, each_batch=each)
    return spark.read.parquet(f"{path}/rows"), batches


@pytest.mark.parametrize("shuffle", [0, 2])
def test_positions(spark, sf, shuffle):
    f = views.fills(spark, sf).select("instrument", *slots.FILL)
    want = {r.execution_id: r for r in signed_positions(f).collect()}
    stream = slots.positions(feed(spark, f, "ts", 9, shuffle), delay="20 days", slot="6 hours")
    out, batches = folded(spark, stream, slots.positions_step)
    got = out.collect()
    assert len(batches) >= 9 and len({r.batch for r in got}) > 1 + (shuffle == 0)
    assert len(got) == len({r.execution_id for r in got}) == len(want)
    for g in got:
        w = want[g.execution_id]
        for c in ("qty", "avg_cost", "open_slippage", "realized"):
            assert g[c] == pytest.approx(w[c], abs=1e-7), (c, g, w)
        assert g.opposes == w.opposes


def test_regimes(spark):
    z, x, _, _ = sample_chain(700, 9)
    a = chain_frame(spark, x, z)
    obs = a.unionByName(a.limit(90).withColumn("instrument", F.lit("B"))).withColumn("event_time", F.expr("timestampadd(MINUTE, cast(substr(event_id, 2) as int) * 7, timestamp'2024-01-01')"))
    models = regime.models_from(regime.state_sums(obs.where("instrument = 'A'")))
    want = {(r.instrument, r.event_id): r.probs for r in regime.causal_filter(obs, models).collect()}
    stream = slots.regimes(feed(spark, obs.drop("state"), "event_time", 8, 1), delay="2 days", slot="2 hours")
    out, batches = folded(spark, stream, slots.regimes_step(models))
    got = {(r.instrument, r.event_id): r.probs for r in out.collect()}
    assert len(batches) >= 8 and out.select("batch").distinct().count() > 3 and got.keys() == want.keys()
    for k, p in want.items():
        assert (p is None and got[k] is None) or np.allclose(p, got[k], atol=1e-9)


def test_no_entry_above_a_slot(spark, sf):
    """What waits in the state is a slot's part, never a whole key."""
    f = views.fills(spark, sf).select("instrument", *slots.FILL)
    sizes = []
    drain(slots.positions(feed(spark, f, "ts", 3), delay="1 day", slot="6 hours"),
          each_batch=lambda b, n: sizes.extend(r.n for r in b.select(F.size("rows").alias("n")).collect()))
    per_slot = f.groupBy("instrument", F.window("ts", "6 hours")).count().agg(F.max("count")).first()[0]
    assert sum(sizes) == f.count() and max(sizes) <= per_slot


def quotes(spark, n, minutes):
    """n fills and n ticks of two instruments and none over some minutes, some ticks at equal times."""
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.floor(F.col("id") * (minutes * 60 / n)).cast("long") * 1_000_000)
    name = F.when(F.col("id") % 11 == 3, None).when(F.col("id") % 2 == 0, "A").otherwise("B").alias("instrument")
    f = spark.range(n).select(F.concat(F.lit("x"), "id").alias("execution_id"), name, at.alias("ts"), F.expr("nullif(id % 5 * 0.5D, -1D)").alias("quantity"))
    gap = F.expr("make_interval(0, 0, 0, 0, 0, 0, (id * 7) % 100)")
    t = spark.range(n).select(F.concat(F.lit("t"), F.col("id") % 97).alias("tick_id"), name, (at - gap).alias("ts"), F.expr("nullif(id * 1D, -1D)").alias("price"))
    return f, t.dropDuplicates(["instrument", "ts", "tick_id"])


def test_arrivals(spark):
    """Over many batches, with fills that come twice: as the batch join, a tick of an earlier batch included."""
    f, t = quotes(spark, 500, 240)
    want = {r.execution_id: r.arrival for r in tca.arrival_join(f.where("instrument is not null"), t).collect()}
    want |= {r.execution_id: None for r in f.where("instrument is null").collect()}
    twice = f.unionByName(f.where("quantity = 0"))
    stream, step = jobs.tca_stream(feed(spark, twice, "ts", 4), feed(spark, t, "ts", 4))
    out, batches = folded(spark, stream, step)
    got = out.where("execution_id <> ''").collect()
    assert len(batches) >= 4 and len({r.batch for r in got}) > 2 and len(got) == len(want) == 500
    assert {r.execution_id: r.arrival for r in got} == want and out.columns == ["execution_id", "instrument", "quantity", "ts", "arrival", "batch"]
    assert sum(v is not None for v in want.values()) > 100


def test_arrivals_are_not_paired(spark):
    """In a busy minute each fill and tick waits once; they are not joined with each other."""
    f, t = quotes(spark, 600, 1)
    stream, _ = jobs.tca_stream(feed(spark, f, "ts", 1), feed(spark, t, "ts", 1))
    rows = []
    drain(stream, each_batch=lambda b, n: rows.append(b.select(F.sum(F.size("rows"))).first()[0] or 0))
    assert sum(rows) == f.count() + t.count() and "Join" not in stream._jdf.queryExecution().analyzed().toString()

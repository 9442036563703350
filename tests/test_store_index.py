"""The store's id index, and headlines that are remembered for two hours."""

import io
import random
import uuid
from contextlib import redirect_stdout

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_market import ts

from tapeworks.operators import quality, store
from tapeworks.session import durable_dir

SCHEMA = "event_id string, instrument string, event_time timestamp, ingest_time timestamp, obi double"


def rows(ids, day=1, obi=0.0):
    return [(i, "A", ts("2024-01-01") + pd.Timedelta(days=day, seconds=k), ts("2024-01-01") + pd.Timedelta(days=day, seconds=k + 1), obi) for k, i in enumerate(ids)]


@pytest.fixture
def path(spark):
    return f"{durable_dir(spark)}/store-{uuid.uuid4().hex}"


def counts(spark, path):
    return {r.event_id: r["count"] for r in spark.read.parquet(path).groupBy("event_id").count().collect()}


def test_an_id_over_three_batches_stays_single(spark, path):
    frame = lambda ids, **k: spark.createDataFrame(rows(ids, **k), SCHEMA)
    names = [f"e{i}" for i in range(300)]
    store.append_indexed(frame([*names, "e7", None, " "]), path, 0)
    store.append_indexed(frame(["e7", "n1", "e299", None], day=9, obi=1.0), path, 1)
    store.append_indexed(frame([*names, "n1", "n2"], day=20, obi=2.0), path, 2)
    got = counts(spark, path)
    assert {k: v for k, v in got.items() if k and k.strip()} == {n: 1 for n in [*names, "n1", "n2"]}
    assert sum(v for k, v in got.items() if not k or not k.strip()) == 3
    first = {r.event_id: r.obi for r in spark.read.parquet(path).collect()}
    assert (first["e7"], first["n1"], first["n2"]) == (0.0, 1.0, 2.0)
    store.compact_ids(spark, path)
    store.append_indexed(frame(["e1", "n2", "n3"], day=30), path, 3)
    again = counts(spark, path)
    assert again["e1"] == again["n2"] == again["n3"] == 1


def test_a_batch_that_failed_between_its_writes(spark, path, monkeypatch):
    frame = spark.createDataFrame(rows([f"e{i}" for i in range(50)]), SCHEMA)
    store.append_indexed(frame.limit(20), path, 0)
    with monkeypatch.context() as m:
        m.setattr(store, "_append", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.append_indexed(frame, path, 1)
    for _ in range(2):  # repeated until it lasts, and once more
        store.append_indexed(frame, path, 1)
    assert counts(spark, path) == {f"e{i}": 1 for i in range(50)}


def test_index_scan_is_pruned(spark, path):
    store.append_indexed(spark.createDataFrame(rows([f"e{i}" for i in range(500)]), SCHEMA), path, 0)
    ids = spark.createDataFrame([("e3",), ("zz",)], "id string")
    entries = store.known_ids(ids, store.id_index(path))
    with redirect_stdout(io.StringIO()) as out:
        entries.explain("formatted")
    plan = out.getvalue()
    assert "PartitionFilters: [bucket" in plan.replace("PartitionFilters: [isnotnull(bucket", "PartitionFilters: [bucket") or "bucket" in plan.split("PartitionFilters:")[1].split("\n")[0]
    assert "id,e3" in plan.split("PushedFilters:")[1].split("\n")[0]
    assert len(entries.inputFiles()) <= store.BUCKETS and [r.id for r in entries.collect()] == ["e3"]
    opened = {f.split("bucket=")[1].split("/")[0] for f in entries.select(F.input_file_name().alias("f")).toPandas().f}
    assert len(opened) == 1
    assert store.known_ids(ids, path + "-none") is None


def plain(headlines, seconds=7200):
    """Ids kept when rows come in order and a title is forgotten `seconds` after it was kept."""
    last, kept = {}, set()
    for i, title, at in sorted(headlines, key=lambda h: (h[2], h[0])):
        if title not in last or (at - last[title]).total_seconds() >= seconds:
            last[title] = at
            kept.add(i)
    return kept


def test_headlines_expire(spark):
    rng, made = random.Random(4), []
    start = ts("2024-01-01")
    for i in range(600):  # bursts, chains of near repeats, ties, and titles that come once
        title = rng.choice(["burst", "chain", "chain", None, f"once {i}", f"pair {i % 40}"])
        minutes = {"burst": rng.choice([0, 1, 119, 120, 121, 400]), "chain": i * 7}.get(title, rng.randrange(900))
        made.append((i, title, start + pd.Timedelta(minutes=minutes)))
    df = spark.createDataFrame(made, "headline_id long, title string, processed_at timestamp").repartition(5)
    got = [r.headline_id for r in quality.dedup_headlines_within(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(made)
    assert quality.dedup_headlines_within(df.where("false")).count() == 0
    assert len(plain(made)) > quality.dedup_headlines(df, order=["processed_at", "headline_id"]).count()


def test_one_title_kept_many_times(spark):
    df = spark.range(900).selectExpr("id as headline_id", "'same' as title", "timestampadd(MINUTE, cast(id * 50 as int), timestamp'2024-01-01') as processed_at")
    got = sorted(r.headline_id for r in quality.dedup_headlines_within(df).collect())
    assert got == list(range(0, 900, 3))

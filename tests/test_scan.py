"""Ordered scans against brute force, with one hot key and one very common order value."""

import random

import pytest
from pyspark.sql import functions as F

from tapeworks.functions import scan
from tapeworks.functions.asof import asof_join
from tapeworks.functions.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    # a third of all rows share one order value, and one key holds most rows
    return [(f"u{i:04d}", rng.choice("aaab"), 500 if i % 3 == 0 else rng.randint(0, 900), rng.choice([None, 1, 2, -3]))
            for i in range(900)]


@pytest.mark.parametrize("blocks", [1, 6, 50])
@pytest.mark.parametrize("descending", [False, True])
def test_running_matches_sequential(spark, rows, blocks, descending):
    df = spark.createDataFrame(rows, "uid string, key string, t long, v long")
    cuts = scan.order_cuts(df, ["t", "uid"], blocks=blocks)
    if blocks == 50:
        assert any(len(t[1]) > 3 for t in cuts.ties)  # the common value is split too
    got = {r.uid: r for r in scan.running(
        df, {"s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "m": ("max", F.col("v")), "l": ("last", F.col("v")),
             "g": ("lag", F.col("v")), "b": ("min", F.col("v"), "before")},
        key=["key"], order=["t", "uid"], cuts=cuts, descending=descending).collect()}
    assert len(got) == len(rows)
    for key in "ab":
        seen, prev = [], None
        for uid, _, _, v in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]), reverse=descending):
            old = [x for x in seen if x is not None]
            seen.append(v)
            known = [x for x in seen if x is not None]
            g = got[uid]
            assert g.n == len(seen)
            assert g.s == (sum(known) if known else None)
            assert g.m == (max(known) if known else None)
            assert g.l == (known[-1] if known else None)
            assert g.b == (min(old) if old else None)
            assert g.g == prev
            prev = v


def test_blocks_bound_group_size(spark, rows):
    df = spark.createDataFrame(rows, "uid string, key string, t long, v long")
    cuts = scan.order_cuts(df, ["t", "uid"], blocks=50)
    biggest = scan.with_block(df, ["t", "uid"], cuts).groupBy(scan.BLOCK).count().agg(F.max("count")).first()[0]
    assert biggest < len(rows) / 10


@pytest.mark.parametrize("rows_per_run", [70, 10_000])
def test_framed_windows_cross_runs(spark, rows, rows_per_run):
    df = spark.createDataFrame(rows, "uid string, key string, t long, v long").fillna(0)
    f, w = scan.framed(df, key=["key"], order=["t", "uid"], before=20, after=5, rows=rows_per_run)
    f = f.withColumns({"back": F.sum("v").over(w.rowsBetween(-19, 0)), "ahead": F.lead("v", 5).over(w)})
    got = {r.uid: r for r in scan.own_rows(f).collect()}
    assert len(got) == len(rows)
    for key in "ab":
        xs = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        vs = [r[3] or 0 for r in xs]
        for i, r in enumerate(xs):
            assert got[r[0]].back == sum(vs[max(0, i - 19):i + 1])
            assert got[r[0]].ahead == (vs[i + 5] if i + 5 < len(vs) else None)


@pytest.mark.parametrize("blocks", [1, 9])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_matches_brute_force(spark, blocks, strict, forward):
    rng = random.Random(5)
    left = [(f"l{i}", rng.choice("aab"), rng.randint(0, 60)) for i in range(120)]
    right = [(f"r{i:03d}", rng.choice("aab"), rng.randint(0, 60), i * 1.0) for i in range(80)]
    at = lambda c: F.timestamp_seconds(c)
    l = spark.createDataFrame(left, "uid string, instrument string, s long").withColumn("ts", at("s"))
    r = spark.createDataFrame(right, "rid string, instrument string, s long, p double").withColumn("ts", at("s"))
    cuts = scan.order_cuts(l.select(F.col("ts").alias("__t"), F.col("uid").alias("__uid")), ["__t"], blocks=blocks)
    out = asof_join(l, r, left_time="ts", right_time="ts", left_uid="uid", right_uid="rid",
                    take={"rp": "p", "rs": "s"}, strict=strict, forward=forward, tolerance="8 seconds", cuts=cuts)
    got = {x.uid: x for x in out.collect()}
    for uid, key, s in left:
        if forward:
            near = [x for x in right if x[1] == key and (x[2] > s if strict else x[2] >= s)]
            best = min(near, key=lambda x: (x[2], x[0]), default=None)
        else:
            near = [x for x in right if x[1] == key and (x[2] < s if strict else x[2] <= s)]
            best = max(near, key=lambda x: (x[2], x[0]), default=None)
        want = best[3] if best and abs(best[2] - s) <= 8 else None
        assert got[uid].rp == want, (uid, key, s, got[uid], best)


def test_exact_quantiles(spark):
    df = spark.createDataFrame([(k, float(v)) for k in "ab" for v in [5, 1, 1, 1, 9, 7]], "k string, v double")
    rows = exact_quantiles(df, key=["k"], value="v", probs={"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}).collect()
    for r in rows:
        assert (r.p0, r.p50, r.p90, r.p100) == (1.0, 3.0, 8.0, 9.0)

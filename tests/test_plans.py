"""Shapes of physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

from tapeworks.functions.scan import order_cuts, running
from tapeworks.operators import bars, store, tca
from tapeworks.plans import views
from tapeworks.session import durable_dir


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, sf):
    path = f"{durable_dir(spark)}/plan-store"
    f = views.features(spark, sf).withColumns({"known_at": store.known_at(), "event_date": F.to_date("event_time")})
    f.write.mode("overwrite").partitionBy("event_date").parquet(path)
    return spark.read.parquet(path)


def test_time_guards_reach_the_scan(table):
    table.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "1000")
    p = plan(store.features_as_of(table, views.AS_OF_MID, take=["obi"]))
    pushed = p[p.index("PushedFilters"):]
    assert "midPrice" not in pushed and "momentum" not in pushed
    assert "LessThanOrEqual(event_time" in pushed and "LessThanOrEqual(ingest_time" in pushed
    assert "Window" not in p
    for df in (store.features_as_of(table, views.AS_OF_MID), store.training_window(table, views.AS_OF_MID), store.revisions_as_of(table, views.AS_OF_MID)):
        p = plan(df)
        assert "event_date" in p[p.index("PartitionFilters"):].split("]")[0]


def test_only_needed_columns_are_read(table):
    p = plan(store.feature_sources(table))
    schema = p[p.index("ReadSchema"):]
    assert "obi" not in schema and "midPrice" not in schema


def test_history_is_a_top_k(table):
    assert "TakeOrderedAndProject" in plan(store.feature_history(table, "ETH-USDT"))


def test_scans_split_a_hot_key(spark, sf):
    f = views.fills(spark, sf)
    cuts = order_cuts(f, ["ts", "execution_id"], blocks=8)
    p = plan(running(f, {"n": ("count", F.lit(1))}, key=["instrument"], order=["ts", "execution_id"], cuts=cuts))
    assert "hashpartitioning(instrument" in p and "__blk" in p
    assert "SinglePartition" not in p


def test_joins_are_never_nested_loops(spark, sf):
    t = tca.arrival_join(views.fills(spark, sf), views.ticks(spark, sf))
    for p in (plan(t), plan(tca.tca_summary(tca.tca_per_fill(t)))):
        assert "CartesianProduct" not in p and "NestedLoop" not in p


def test_bars_aggregate_before_the_shuffle(spark, sf):
    p = plan(bars.bars(views.trade_ticks(spark, sf)))
    assert "partial_max" in p and p.count("Exchange hashpartitioning") == 1

"""The curve against its definition, and shards against ranks."""

import zlib
from collections import defaultdict

import duckdb
import pytest
from odd_rows import CLASHES, ROWS
from pyspark.sql import functions as F

from tapeworks.llm import hilbert, queries


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(spark, dims, bits):
    side = 1 << bits
    df = spark.range(side**dims).select(*[F.expr(f"cast((id div {side**i}) % {side} as int) as c{i}") for i in range(dims)])
    rows = df.select("*", hilbert.curve_index([F.col(f"c{i}") for i in range(dims)], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(side**dims))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(x - y) for x, y in zip(a[:dims], b[:dims])) == 1


def check(rows, want, shards):
    assert sorted(((r.id, r.size, r.text_crc32) for r in rows), key=str) == sorted(want, key=str)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert max(slots, default=0) < shards
    n = [len(slots[s]) for s in range(shards)]
    assert max(n) - min(n) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_odd_rows(odd, empty):
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS]
    for shards in (1, 4, 16):
        check(hilbert.assign(odd, shards=shards).collect(), want, shards)
    assert hilbert.assign(empty).count() == 0


def test_shards_follow_the_curve(documents):
    rows = sorted(hilbert.assign(documents).collect(), key=lambda r: (r.shard, r.slot))
    order = [(r.curve, r.text_crc32, r.id) for r in rows]
    assert order == sorted(order)


def test_files_prune(spark, documents, tmp_path):
    path = f"{tmp_path}/s"
    hilbert.write_shards(documents, path, rows_per_file=5)
    got = spark.read.parquet(path)
    assert sorted(got.columns) == sorted([*documents.columns, "shard"])
    assert sorted(map(str, got.drop("shard").select(*documents.columns).collect())) == sorted(map(str, documents.collect()))
    # a box of the three dimensions touches fewer files than one that knows nothing
    spread = got.groupBy(F.input_file_name()).agg(F.min("n_chars").alias("a"), F.max("n_chars").alias("b"), F.min("lang").alias("c"), F.max("lang").alias("d")).collect()
    hit = sum(r.a <= 300 and r.c <= "en" <= r.d for r in spread)
    assert hit < 0.5 * len(spread)


def test_odd_files(spark, odd, tmp_path):
    hilbert.write_shards(odd, f"{tmp_path}/o")
    got = spark.read.parquet(f"{tmp_path}/o")
    assert got.count() == len(ROWS) and set(got.columns) == {*odd.columns, "shard_"}
    assert {r.shard for r in got.select("shard").distinct().collect()} == {"x"}


def test_long_common_beginnings(spark):
    """Sources that agree on many bytes still spread over the cells of their dimension."""
    df = spark.range(640).selectExpr("id as doc_id", "concat('t', id) as text", "'en' as lang", "concat('https://www.example.org/site-', lpad(id % 64, 3, '0')) as source", "10L as n_chars")
    rows = hilbert.assign(df, dims=("source", "n_chars")).collect()
    curve = {}
    for r in rows:
        curve.setdefault(r.id % 64, set()).add(r.curve)
    assert all(len(c) == 1 for c in curve.values()) and len({min(c) for c in curve.values()}) >= 60


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    name = "op3_hilbert_shards"
    rel = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in rel.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(str, df.select(*cols).collect())) == sorted("Row(" + ", ".join(f"{c}={v!r}" for c, v in zip(cols, r)) + ")" for r in rel.fetchall())

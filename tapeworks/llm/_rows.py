"""Small shared pieces: row keys, partition counts, Arrow batches, temporary tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("__k_id", "__k_row")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id_col: Column, *cols: Column) -> list[Column]:
    """Two longs that stand for a row: its id and a 64-bit hash of the given columns.

    Nulls are hashed as such, so a null and an empty value differ. Rows with the same key are
    repeats of one another; only rows of one id (or without any) can meet in the hash.
    """
    parts = [x for c in (id_col, *cols) for x in (c.isNull(), c)]
    return [F.coalesce(id_col.cast("long"), F.lit(0)).alias(KEY[0]), F.xxhash64(*parts).alias(KEY[1])]


def with_key(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """All columns of df, and its row key under two names that df must not have."""
    return df.select("*", *row_key(df[id_col], *[df[c] for c in cols]))


def delete(spark: SparkSession, df_path: str) -> None:
    """Remove a folder below the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def whole_groups(source: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Regroup sorted batches so that equal keys are never in two batches."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in source:
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            col = batch.column(k).to_numpy(zero_copy_only=False)
            same &= col == col[last]
        first = int(same.argmax()) if same.all() else int(len(same) - np.argmin(same[::-1]))
        if held and first == 0 and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys):
            held.append(batch)
            continue
        if first:
            held.append(batch.slice(0, first))
        yield from _joined(held)
        held = [batch.slice(first)]
    yield from _joined(held)


def _joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

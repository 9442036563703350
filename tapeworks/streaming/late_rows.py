"""Late rows kept aside: a stream is split by its watermark before the operator, not dropped in it.

A batch is written once, split into rows in time and rows that came after the watermark; then
the operator's own query takes in what was in time. Both see the same batches, so its watermark
is the one that split them, and nothing it is given is late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.session import exists


def split(batch: DataFrame, batch_id: int, base: str, *, time: str, delay: str) -> None:
    """Write a batch to base/split/batch=N/late=true|false, and the latest time seen to base/mark/batch=N.

    A row is late if its time is more than `delay` before the latest of all earlier batches; rows
    without a time are not. The mark comes last: with it the batch is done, and a repeat after a
    failure leaves its files alone.
    """
    spark, mark = batch.sparkSession, f"{base}/mark/batch={batch_id}"
    if exists(spark, mark):
        return
    top = spark.read.parquet(f"{base}/mark/batch={batch_id - 1}").first()["top"] if batch_id else None
    cut = F.lit(top).cast("timestamp") - F.expr(f"interval {delay}")
    tagged = batch.withColumn("late", F.coalesce(F.col(time) < cut, F.lit(False)))
    tagged.write.mode("overwrite").partitionBy("late").parquet(f"{base}/split/batch={batch_id}")
    rows = spark.read.schema(tagged.schema).parquet(f"{base}/split/batch={batch_id}")
    rows.agg(F.greatest(F.max(time), F.lit(top).cast("timestamp")).alias("top")).coalesce(1).write.parquet(mark)


def aside(base: str, build: Callable[[DataFrame], DataFrame], *, time: str, delay: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: late rows to base/split, and the output of build(rows in time) to base/out.

    build sets its watermark on `time` with the same delay. A batch that failed is repeated: its
    split stands once written, and the operator's query goes on from its own checkpoint.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        split(batch, batch_id, base, time=time, delay=delay)
        if not exists(spark, f"{base}/split/batch={batch_id}/late=false"):
            return
        kept = spark.readStream.schema(batch.schema).parquet(f"{base}/split/batch=*/late=false")
        writer = build(kept).writeStream.option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").format("parquet")
        writer.trigger(availableNow=True).start().awaitTermination()

    return write


def late(spark: SparkSession, base: str) -> DataFrame:
    """All rows that came too late, with the number of their batch."""
    return spark.read.parquet(f"{base}/split").where(F.col("late").cast("boolean")).drop("late")

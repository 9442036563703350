"""Point-in-time feature store: only what was known at T may be seen at T."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.scan import running
from tapeworks.session import exists, materialize

HISTORY_LIMIT = 50


def known_at() -> Column:
    """The first moment both clocks allow the row to be seen; stored, so it can be pushed down."""
    return F.greatest("event_time", "ingest_time")


def _visible(store: DataFrame, as_of) -> Column:
    """Both clocks allow the row at T; a store partitioned by event date is pruned to the days up to T."""
    t = F.lit(as_of).cast("timestamp")
    seen = (F.col("event_time") <= t) & (F.col("ingest_time") <= t)
    return seen & (F.col("event_date") <= F.to_date(t)) if "event_date" in store.columns else seen


def features_as_of(store: DataFrame, as_of, *, instrument: str | None = None, uid="event_id",
                   take: list[str] | None = None) -> DataFrame:
    """The latest visible version per instrument: one pass with a partial aggregate per task.

    `take` names the wanted columns, so that only they are read.
    """
    seen = store.where(_visible(store, as_of))
    if instrument is not None:
        seen = seen.where(F.col("instrument") == instrument)
    rest = [c for c in take or store.columns if c != "instrument"]
    return (
        seen.groupBy("instrument")
        .agg(F.max_by(F.struct(*rest), F.struct("event_time", "ingest_time", uid)).alias("r"))
        .select("instrument", "r.*")
    )


def feature_history(store: DataFrame, instrument: str, *, limit: int = HISTORY_LIMIT, uid="event_id") -> DataFrame:
    n = max(limit, 1)
    return store.where(F.col("instrument") == instrument).orderBy(
        F.desc("ingest_time"), F.desc("event_time"), F.desc(uid)
    ).limit(n)


def feature_sources(store: DataFrame) -> DataFrame:
    lag = (F.unix_micros("ingest_time") - F.unix_micros("event_time")) / 1e6
    return store.groupBy("instrument").agg(
        F.count("*").alias("events"), F.min("event_time").alias("first_event"),
        F.max("event_time").alias("last_event"), F.max("ingest_time").alias("last_ingest"),
        F.greatest(F.max(lag), F.lit(0.0)).alias("max_lag_secs"),
    )


def pit_join(spine: DataFrame, store: DataFrame, *, take: list[str], at: str = "decision_time",
             spine_uid: str = "spine_id", uid: str = "event_id") -> DataFrame:
    """For each spine row, what `features_as_of` would answer at its own time.

    A version is visible at T exactly when known_at <= T, so the answer is a running maximum
    of (event_time, ingest_time, id, payload) along known_at.
    """
    version = F.struct("event_time", "ingest_time", F.col(uid).cast("string").alias("id"),
                       F.struct(*take).alias("p"))
    when = F.col("known_at") if "known_at" in store.columns else known_at()
    right = store.select(
        "instrument", when.alias("__t"), F.lit(0).alias("__side"), F.col(uid).cast("string").alias("__u"),
        version.alias("__v"), F.lit(None).alias("__row"),
    )
    own = [c for c in spine.columns if c != "instrument"]
    left = spine.select(
        "instrument", F.col(at).alias("__t"), F.lit(1).alias("__side"),
        F.col(spine_uid).cast("string").alias("__u"), F.lit(None).alias("__v"), F.struct(*own).alias("__row"),
    )
    found = running(
        left.unionByName(right), {"__hit": ("max", F.col("__v"))},
        key=["instrument"], order=["__t", "__side", "__u"],
    ).where(F.col("__row").isNotNull())
    return found.select(
        "instrument", "__row.*", F.col("__hit.event_time").alias("feature_event_time"),
        F.col("__hit.ingest_time").alias("feature_ingest_time"), F.col("__hit.id").alias("feature_id"),
        *[F.col("__hit.p")[c].alias(c) for c in take],
    )


def training_window(store: DataFrame, as_of) -> DataFrame:
    """Every row both clocks allow at T."""
    return store.where(_visible(store, as_of))


def lookahead_audit(joined: DataFrame, *, at: str = "decision_time") -> DataFrame:
    """Joined rows that saw the future; must be empty."""
    t = F.col(at)
    leak = (F.col("feature_event_time") > t) | (F.col("feature_ingest_time") > t)
    if "window_end" in joined.columns:
        leak = leak | F.coalesce(F.col("window_end") > t, F.lit(False))
    return joined.where(leak)


def revisions_as_of(store: DataFrame, as_of, *, uid="event_id", take: list[str] | None = None) -> DataFrame:
    """Of several versions of one event time, the latest that is visible at T."""
    rest = [c for c in take or store.columns if c not in ("instrument", "event_time")]
    return (
        store.where(_visible(store, as_of)).groupBy("instrument", "event_time")
        .agg(F.max_by(F.struct(*rest), F.struct("ingest_time", uid)).alias("r"), F.count("*").alias("versions"))
        .select("instrument", "event_time", "versions", "r.*")
    )


def new_rows(batch: DataFrame, store: DataFrame, *, uid="event_id") -> DataFrame:
    """First arrivals of a batch that the store does not hold yet; rows without an id always are.

    An id is unique whatever its date, so all ids of the store are looked at: one narrow column,
    joined by its hash. The batch is written once, as it is read for named and unnamed rows.
    """
    from tapeworks.operators.quality import dedup_events

    first = materialize(dedup_events(batch, order=["ingest_time", "event_time"], event_id=uid), "batch")
    named = first.where(F.col(uid).isNotNull()).join(store.select(uid).where(F.col(uid).isNotNull()), uid, "left_anti")
    return named.unionByName(first.where(F.col(uid).isNull()))


def append_to_store(batch: DataFrame, store: DataFrame, path: str, *, uid="event_id") -> None:
    """Append the new rows, partitioned by event date and sorted for file statistics."""
    _append(new_rows(batch, store, uid=uid), path)


def _append(new: DataFrame, path: str) -> None:
    rows = new.withColumns({"known_at": known_at(), "event_date": F.to_date("event_time")})
    rows.repartitionByRange("event_date", "instrument", "event_time").sortWithinPartitions(
        "event_date", "instrument", "event_time"
    ).write.mode("append").partitionBy("event_date").parquet(path)


# --- the ids of a store ------------------------------------------------------------------------

BUCKETS = 64
#: Up to so many ids of a batch are looked for by value, so that Bloom filters skip files.
LITERALS = 200
_INDEX = "id string, batch long, bucket int"


def id_bucket(uid: Column) -> Column:
    return F.pmod(F.xxhash64(uid.cast("string")), F.lit(BUCKETS)).cast("int")


def id_index(path: str) -> str:
    """The folder of a store's ids, next to the store."""
    return f"{path.rstrip('/')}.ids"


def known_ids(ids: DataFrame, index: str) -> DataFrame | None:
    """The entries of the index that a batch's ids (one column `id`) can hit, or None without an index.

    Only the buckets of the batch are opened, and a small batch asks for its ids by value: then
    the Bloom filter of each file, written with the ids, and their range decide.
    """
    spark = ids.sparkSession
    if not exists(spark, index):
        return None
    hit = [r["b"] for r in ids.select(id_bucket(F.col("id")).alias("b")).distinct().collect()]  # at most BUCKETS numbers
    entries = spark.read.schema(_INDEX).parquet(index).where(F.col("bucket").isin(hit))
    few = [r["id"] for r in ids.limit(LITERALS + 1).collect()]
    if 0 < len(few) <= LITERALS:
        asked = F.col("id") == few[0]
        for x in few[1:]:
            asked = asked | (F.col("id") == x)
        entries = entries.where(asked)
    return entries


def _write_ids(rows: DataFrame, index: str, mode: str) -> None:
    rows.withColumn("bucket", id_bucket(F.col("id"))).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "id").write.mode(mode).option(
        "parquet.bloom.filter.enabled#id", "true").partitionBy("bucket").parquet(index)


def append_indexed(batch: DataFrame, path: str, batch_id: int, *, uid="event_id") -> None:
    """Append a batch's first arrivals whose ids the store does not hold; rows without an id always.

    The index learns the ids before the store gets the rows, each with the number of its batch:
    a repeated batch passes over its own entries and, there alone, asks the store itself what of
    it had arrived. So a failure between the two writes neither loses nor doubles a named row.
    """
    from tapeworks.operators.quality import blank_to_null, dedup_events

    spark, index = batch.sparkSession, id_index(path)
    first = materialize(dedup_events(batch, order=["ingest_time", "event_time"], event_id=uid), "batch")
    name = blank_to_null(F.col(uid))
    ids = first.select(name.cast("string").alias("id")).where("id is not null")
    entries = known_ids(ids, index)
    tagged = first.withColumn("__id", name.cast("string"))
    repeated = False
    if entries is not None:
        others = entries.where(F.col("batch") != batch_id).select(F.col("id").alias("__id"))
        tagged = tagged.join(others, "__id", "left_anti")
        repeated = not entries.where(F.col("batch") == batch_id).isEmpty()
    fresh = materialize(tagged, "fresh")
    if repeated:
        fresh = fresh.join(spark.read.parquet(path).select(F.col(uid).cast("string").alias("__id")).distinct(), "__id", "left_anti") if exists(spark, path) else fresh
    else:
        _write_ids(fresh.where("__id is not null").select(F.col("__id").alias("id"), F.lit(batch_id).cast("long").alias("batch")), index, "append")
    _append(fresh.drop("__id"), path)


def compact_ids(spark: SparkSession, path: str) -> None:
    """Rewrite the index with one sorted file a bucket, beside the old one, and put it in its place.

    To be run while no batch is being written.
    """
    index = id_index(path)
    done = f"{index}-{uuid.uuid4().hex}"
    _write_ids(spark.read.schema(_INDEX).parquet(index).drop("bucket"), done, "error")
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    old, new = hadoop.Path(index), hadoop.Path(done)
    fs = old.getFileSystem(conf)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"the compacted index stays at {done}")

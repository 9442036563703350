"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "tapeworks", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


_LOCAL_DIRS: dict[str, str] = {}


def durable_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    context = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if path:
        return path.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="tapeworks-")
    return _LOCAL_DIRS[context.applicationId]


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame that several branches read to the shared folder and read it back.

    One pass over the inputs, short lineage, and the files survive lost executors.
    """
    spark = df.sparkSession
    path = f"{durable_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

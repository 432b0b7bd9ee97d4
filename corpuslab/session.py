"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Measured bytes above which a dimension-like side is no longer broadcast.
BROADCAST_MAX_BYTES = 64 << 20


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "corpuslab") -> SparkSession:
    """Session used by tests and bench; on a cluster the caller's session is used as is."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset (tests, local runs)
    create a scratch folder of our own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="corpuslab-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return local


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read again. It cuts lineage as ``checkpoint()`` does, but
    its size is that of its files: a checkpoint keeps the estimate of its plan, and in a loop that joins its state
    several times this estimate (a product of sizes, without limit) soon takes longer than the work."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Arrow batches that Python workers are handed hold at most about ``size`` bytes while this lasts, for stages that run
    inside it: a batch of 64 MB takes several times that in the executor, outside its heap, and in the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables of ``written`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

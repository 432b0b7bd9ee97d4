"""Driver tables: one Parquet file (or folder) per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan a table. When the files yield fewer input splits than the cluster has cores (one
    small file with a single row group), spread the rows round-robin over the cores so that
    per-row work (regex tokenisation, array math) is not serialised in one task. On large
    inputs there are already more splits than cores and this is a no-op (no extra shuffle)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def head_n(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """First n rows in an explicit order (planned as TakeOrderedAndProject: each task keeps n,
    the driver merges P x n) - the head-of-corpus subset option; registered queries use whole
    tables."""
    return df.orderBy(order_col).limit(n)

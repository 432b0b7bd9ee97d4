"""Run-log files: summary CSV / JSON, generations CSV / JSONL, epoch logs, run folders; and
the sinks that write them. Every reader takes an explicit schema (no inference pass)."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.session import dropped, ensure_checkpoint_dir, written

SUMMARY_SCHEMA = T.StructType([
    T.StructField("activation", T.StringType()),
    T.StructField("avg_loss", T.DoubleType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("block_size", T.IntegerType()),
    T.StructField("chunk_size", T.IntegerType()),
    T.StructField("config_name", T.StringType()),
    T.StructField("embed_size", T.IntegerType()),
    T.StructField("epoch", T.DoubleType()),
    T.StructField("grad_norm", T.DoubleType()),
    T.StructField("grad_norm_postclip", T.DoubleType()),
    T.StructField("grad_norm_preclip", T.DoubleType()),
    T.StructField("inner_layers", T.IntegerType()),
    T.StructField("k", T.IntegerType()),
    T.StructField("learning_rate", T.DoubleType()),
    T.StructField("max_param_grad", T.DoubleType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("num_epochs", T.IntegerType()),
    T.StructField("perplexity", T.DoubleType()),
    T.StructField("tinystories_weight", T.DoubleType()),
    T.StructField("token_accuracy", T.DoubleType()),
    T.StructField("token_drift_cosine", T.DoubleType()),
    T.StructField("val_loss", T.DoubleType()),
    T.StructField("weight_norm", T.DoubleType()),
])

GENERATION_SCHEMA = T.StructType([
    T.StructField("checkpoint", T.StringType()),
    T.StructField("generation", T.StringType()),
    T.StructField("annotation", T.StringType()),
])

EPOCH_METRIC = T.StructType([
    T.StructField(n, T.DoubleType())
    for n in ["avg_loss", "val_loss", "perplexity", "token_accuracy", "grad_norm", "grad_norm_preclip", "grad_norm_postclip",
              "max_param_grad", "weight_norm", "learning_rate", "token_drift_cosine"]
])


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder (never machine-local on a
    cluster: ``spark.checkpoint.dir`` names shared storage)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/corpuslab-{name}-{uuid.uuid4().hex[:12]}"


def scan_summary(spark: SparkSession, path: str) -> DataFrame:
    """Summary CSV (header, quoted); columns absent from older files come back NULL."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    cols = []
    for f in SUMMARY_SCHEMA.fields:
        if f.name in raw.columns:
            c = F.col(f.name).try_cast("double")
            cols.append((c.cast("int") if isinstance(f.dataType, T.IntegerType) else c).alias(f.name)
                        if not isinstance(f.dataType, T.StringType) else F.col(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return raw.select(*cols, F.col("_metadata.file_path").alias("source_file"))


def scan_summary_json(spark: SparkSession, glob: str) -> DataFrame:
    """Per-run summary.json (pretty-printed objects, heterogeneous keys, numbers sometimes
    written as strings). Read as strings, then typed with try_cast; the run folder name comes
    from the file path."""
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in SUMMARY_SCHEMA.fields])
    raw = spark.read.schema(schema).option("multiLine", True).option("primitivesAsString", True).json(glob)
    cols = []
    for f in SUMMARY_SCHEMA.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(F.col(f.name))
        else:
            c = F.col(f.name).try_cast("double")
            cols.append((c.cast("int") if isinstance(f.dataType, T.IntegerType) else c).alias(f.name))
    path = F.col("_metadata.file_path")
    run = F.element_at(F.split(path, "/"), -2)
    return raw.select(*cols, run.alias("run_dir"))


def scan_generations_csv(spark: SparkSession, path: str) -> DataFrame:
    """Generations CSV with quoted multi-line fields."""
    df = spark.read.schema(GENERATION_SCHEMA).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return df.withColumn("run_dir", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def scan_generations_jsonl(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(GENERATION_SCHEMA).json(path)
    return df.withColumn("run_dir", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def scan_epoch_log(df: DataFrame, json_col: str, key: str = "run") -> DataFrame:
    """Epoch log stored as JSON ``{"epoch_N": {metric: value, ...}, ...}`` -> one row per
    (run, epoch) with typed metric columns (missing metric -> NULL)."""
    m = F.from_json(F.col(json_col), T.MapType(T.StringType(), EPOCH_METRIC))
    e = df.select(key, F.explode(m).alias("k", "v"))
    return e.select(key, F.regexp_extract("k", r"epoch_(\d+)", 1).try_cast("int").alias("epoch"), "v.*").where(F.col("epoch").isNotNull())


def scan_runs(spark: SparkSession, root: str, marker: str = "*") -> DataFrame:
    """Distributed listing of run folders under ``root``: (run_dir, file) for every file one
    level below a run folder, sorted by run name when collected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", marker).option("recursiveFileLookup", True).load(root).select("path")
    parts = F.split(F.regexp_replace("path", "^file:", ""), "/")
    return files.select(F.element_at(parts, -2).alias("run_dir"), F.element_at(parts, -1).alias("file"))


def append_summary(df: DataFrame, path: str, partition_by: str | None = "model_type") -> None:
    """Append-only sink: columns in name order, Parquet, partitioned (one folder per model)."""
    w = df.select(*sorted(df.columns)).write.mode("append")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def _commits(spark: SparkSession, path: str):
    """File system and folder of the commit log beside the data of ``path``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(f"{path.rstrip('/')}/_commits")
    return hadoop, folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def summary_versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Committed versions in ascending order: number -> data folder. A commit file that is still empty
    (its writer died between creating and filling it) is no version."""
    hadoop, folder, fs = _commits(spark, path)
    if not fs.exists(folder):
        return {}
    files = sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(folder))
    named = [(int(name), size) for name, size in files if name.isdigit() and size]
    if not named:
        return {}
    lines = spark.read.text([f"{path.rstrip('/')}/_commits/{n:012d}" for n, _ in named]).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).cast("long").alias("n"), "value").collect()  # one row a version
    found = {r["n"]: r["value"] for r in lines if r["value"].endswith(";")}  # a torn line has no end mark
    return {n: f"{path.rstrip('/')}/{found[n][:-1]}" for n in sorted(found)}


def write_summary(df: DataFrame, path: str) -> str:
    """Overwrite without touching what is being read: the rows go to a folder of their own, then a commit
    file named by the next number is created (creation fails if another writer has taken the number, which
    then tries the one after) and names that folder. Readers (``read_summary``) follow the newest commit, so
    rows of a writer that died before its commit are never read. Returns the data folder. Needs a file system
    whose create without overwrite is atomic."""
    spark = df.sparkSession
    name = f"data-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{name}")
    hadoop, folder, fs = _commits(spark, path)
    taken = [int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()] if fs.exists(folder) else []
    number = max(taken, default=0) + 1
    while True:
        target = hadoop(folder, f"{number:012d}")
        try:
            out = fs.create(target, False)
        except Py4JJavaError:
            if not fs.exists(target):
                raise
            number += 1
            continue
        out.write(bytearray(f"{name};\n".encode()))
        out.close()
        return f"{path.rstrip('/')}/{name}"


def read_summary(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows of the newest committed version, or of the one asked for."""
    versions = summary_versions(spark, path)
    if not versions or (version is not None and version not in versions):
        raise FileNotFoundError(f"no committed version {version or ''} under {path}")
    return spark.read.parquet(versions[version if version is not None else max(versions)])


def merge_summary(new: DataFrame, path: str, key: str, seq: str) -> str:
    """Newest version and ``new`` merged (per key the row of the largest ``seq`` wins), as the next version."""
    spark = new.sparkSession
    rows = new if not summary_versions(spark, path) else read_summary(spark, path).unionByName(new)
    cols = [c for c in rows.columns if c != key]
    return write_summary(rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("w")).select(key, "w.*"), path)


def export_top(df: DataFrame, path: str, n: int, by: list[str]) -> None:
    """Top-n CSV report with header (one file: the limit bounds it to n rows)."""
    df.orderBy(*by).limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_generations(gen: DataFrame, path: str, partition_by: str = "run") -> None:
    """Dual sink (CSV with quoted multi-line text + JSONL) from one DataFrame, which is written as Parquet (equal texts
    shrink there) until both are done; each sink is written once - not rewritten per record."""
    gen = written(gen)
    gen.write.mode("overwrite").partitionBy(partition_by).option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/csv")
    gen.write.mode("overwrite").partitionBy(partition_by).json(f"{path}/jsonl")
    dropped(gen)


def ols_report_json(spark: SparkSession, fit: dict, path: str) -> None:
    keys = ["n", "r2", "adj_r2", "f", "llf", "aic", "bic", "skew", "kurtosis", "jb", "dw", "cond"]
    row = {k: float(fit[k]) for k in keys}
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(path)

"""Derived views over the driver tables (definitions shared by queries, tests and oracles).

* ``doc_tokens``  documents -> (doc_id, lang, source, toks ARRAY<STRING>), whole texts
* ``tok``         documents -> (doc_id, lang, source, pos from 1, t)
* ``vocab``       tok -> (t, c, token_id): ids by (count desc, token asc); 0 = PAD
* ``doc_ids``     documents -> (doc_id, lang, source, ids ARRAY<INT>)
* ``steps``       events -> training-log steps (run, epoch, split, step, loss, ...)
* ``run_epochs``  steps -> one row per (run, epoch)
* ``runs``        last epoch per run + a configuration derived from the run id
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import scalars as sc
from corpuslab.operators import text as tt
from corpuslab.operators.ranking import exact_rank
from corpuslab.session import small_batches
from corpuslab.sources.tables import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ("doc_id", "lang", "source")
    return tt.token_arrays(documents(spark, sf_dir), keep=keep).select(*keep, F.array_join("toks", " ").alias("line"))


def _kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_lines(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)


def release_tokens(spark: SparkSession, sf_dir: str) -> None:
    """Frees what ``doc_tokens`` keeps, for queries that go on with ids alone."""
    _token_lines(spark, sf_dir).unpersist()


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arrays of the whole documents. Tokenising is the costliest per-row step and several
    derived views (tokens, vocabulary, id arrays) read it, so it is kept materialised
    (memory, spilling to disk) for the session, as one string a document: no token holds a space, and an
    array of short strings takes several times the text's size."""
    keep = ("doc_id", "lang", "source")
    line = _kept_lines(spark, sf_dir)
    toks = F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(F.split("line", " "))
    return line.select(*keep, toks.alias("toks"))


def tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    arr = doc_tokens(spark, sf_dir)
    return arr.select("doc_id", "lang", "source", F.posexplode("toks").alias("pos0", "t")).select(
        "doc_id", "lang", "source", (F.col("pos0") + 1).alias("pos"), "t"
    )


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return tt.ranked_vocab(tt.count_tokens(_kept_lines(spark, sf_dir)))


def doc_ids(spark: SparkSession, sf_dir: str, voc: DataFrame | None = None, made: list[DataFrame] | None = None) -> DataFrame:
    voc = voc if voc is not None else vocab(spark, sf_dir)
    return tt.encode_arrays(doc_tokens(spark, sf_dir), voc, keep=("doc_id", "lang", "source"), made=made)


def step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> step rows without their position: run = user_id, epoch = 6-day block of the
    month (1..5), 'view' events are validation steps, loss = ln(1 + value)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        "event_id",
        "ts",
        "value",
        (F.lit(1) + F.floor((F.dayofmonth("ts") - 1) / 6)).cast("int").alias("epoch"),
        F.when(F.col("event_type") == "view", F.lit("val")).otherwise(F.lit("train")).alias("split"),
        F.log(F.lit(1.0) + F.col("value")).alias("loss"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step rows + step = position inside (run, epoch, split) by (ts, event_id) - a skew-safe
    exact rank (a run may hold a large share of all events)."""
    ev = step_rows(spark, sf_dir)
    ranked = exact_rank(ev, ["ts", "event_id"], partition_by=("run", "epoch", "split"), name="step")
    return ranked.select("run", "epoch", "split", "step", "event_id", "ts", "value", "loss")


def run_epochs(spark: SparkSession, sf_dir: str, st: DataFrame | None = None) -> DataFrame:
    """One row per (run, epoch): a plain aggregation of the step rows (positions not needed)."""
    st = st if st is not None else step_rows(spark, sf_dir)
    train = F.col("split") == "train"
    return st.groupBy("run", "epoch").agg(
        F.sum(F.when(train, 1).otherwise(0)).cast("bigint").alias("n_train"),
        F.sum(F.when(~train, 1).otherwise(0)).cast("bigint").alias("n_val"),
        F.avg(F.when(train, F.col("loss"))).alias("avg_loss"),
        F.avg(F.when(~train, F.col("loss"))).alias("val_loss"),
        F.exp(F.avg(F.when(train, F.col("loss")))).alias("perplexity"),
        F.avg(F.when(train, F.when(F.col("value") < 20, F.lit(1.0)).otherwise(F.lit(0.0)))).alias("token_accuracy"),
        F.max(F.when(train, F.col("loss"))).alias("max_loss"),
        F.min("ts").alias("first_ts"),
    )


def runs(spark: SparkSession, sf_dir: str, re_: DataFrame | None = None) -> DataFrame:
    """Last epoch per run + configuration columns computed from the run id + config_name."""
    re_ = re_ if re_ is not None else run_epochs(spark, sf_dir)
    last = re_.groupBy("run").agg(
        F.max_by(
            F.struct("epoch", "avg_loss", "val_loss", "perplexity", "token_accuracy", "max_loss"), F.col("epoch")
        ).alias("l"),
        F.min("first_ts").alias("start_ts"),
    ).select("run", "l.*", "start_ts")
    cfg = last.select("*", *sc.synthetic_config("run"))
    return cfg.withColumn("config_name", sc.config_name("start_ts")).drop("start_ts")

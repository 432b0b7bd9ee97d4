"""Queries: the streaming operators, each run to completion over the driver tables cut into
time-ordered files, with results equal to the batch operators (same oracle SQL)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import scalars as sc
from corpuslab.plans import q_runlog, views
from corpuslab.plans.catalog import ORACLE, finish, register
from corpuslab.sources import runlogs as rg
from corpuslab.sources.tables import table
from corpuslab.streaming import stateful as stf

SLICES = 5  # arrivals: how often new files come in while the stream stands still
WINDOW_SECONDS = 6 * 86400
STATE_ROWS = 8192  # rows of the whole stream that share a bucket of its state


def epoch_col(ts="ts"):
    return (F.lit(1) + F.floor((F.dayofmonth(ts) - 1) / 6)).cast("int")


def feed(spark: SparkSession, df: DataFrame, name: str, order, run) -> None:
    """Let ``df`` arrive in slices of event time: cut at quantiles of ``order`` (the ends open, so
    every row arrives), each slice written as any number of files; ``run(stream)`` is started anew
    on the same checkpoint for each slice and takes all its files in one micro-batch. No row is
    older than what an earlier micro-batch has seen of its key."""
    src = rg.shared_dir(spark, f"{name}-src")
    shares = [i / SLICES for i in range(1, SLICES)]
    cuts = sorted(set(df.agg(F.percentile_approx(order, shares, 10_000).alias("q")).first()["q"] or []))
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = df
        if low is not None:
            part = part.where(order > low)
        if high is not None:
            part = part.where(order.isNull() | (order <= high) if low is None else order <= high)
        part.write.mode("append").parquet(src)
        run(spark.readStream.schema(df.schema).parquet(src))


def _buckets(spark: SparkSession, df: DataFrame) -> int:
    """Buckets of a stream's state, in proportion to what will arrive: a call's rows stay few whatever the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / STATE_ROWS))


def _micros(ts="ts"):
    return F.unix_micros(sc.utc_instant(ts))


def _steps(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("run"), "event_id", "ts", "value", epoch_col().alias("epoch"),
        F.when(F.col("event_type") == "view", F.lit("val")).otherwise(F.lit("train")).alias("split"),
        F.log(F.lit(1.0) + F.col("value")).alias("loss"),
    )


def _sinks(spark, name):
    return rg.shared_dir(spark, f"{name}-out"), rg.shared_dir(spark, f"{name}-chk")


@register("stream_partial_loss", ORACLE["partial_loss"])
def stream_partial_loss(spark: SparkSession, sf_dir: str):
    out, chk = _sinks(spark, "partial")
    steps = _steps(spark, sf_dir)
    n = _buckets(spark, steps)
    feed(spark, steps, "steps", _micros(), lambda src: stf.run_to_parquet(stf.partial_loss_stream(src, q_runlog.PARTIAL_EVERY, n), out, chk))
    return finish(spark.read.parquet(out).where(F.col("kind") == "bucket").drop("kind", "event_id"))


@register("stream_interval_trigger", ORACLE["interval_trigger"])
def stream_interval_trigger(spark: SparkSession, sf_dir: str):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    out, chk = _sinks(spark, "trigger")
    n = _buckets(spark, ev)
    feed(spark, ev, "events", _micros(), lambda src: stf.run_to_parquet(stf.interval_trigger_stream(src, q_runlog.TRIGGER_US, n), out, chk))
    return spark.read.parquet(out).where(F.col("kind") == "fire").select("user_id", "event_id")


def _epochs(spark, sf_dir):
    re_ = views.run_epochs(spark, sf_dir)
    lr0 = views.runs(spark, sf_dir).select("run", F.col("learning_rate").cast("double").alias("lr0"))
    return re_.join(lr0, "run").select("run", "epoch", "avg_loss", "val_loss", F.col("avg_loss").alias("loss"), "lr0").checkpoint()


@register("stream_plateau_lr", ORACLE["plateau_lr"])
def stream_plateau_lr(spark: SparkSession, sf_dir: str):
    out, chk = _sinks(spark, "plateau")
    epochs = _epochs(spark, sf_dir)
    n = _buckets(spark, epochs)
    feed(spark, epochs, "epochs", F.col("epoch"),
         lambda src: stf.run_to_parquet(stf.plateau_lr_stream(src.select("run", "epoch", "loss", "lr0"), buckets=n), out, chk))
    return finish(spark.read.parquet(out).where(F.col("kind") == "rate").drop("kind"), lr=9)


@register("stream_summaries", ORACLE["last_epoch"])
def stream_summaries(spark: SparkSession, sf_dir: str):
    out, chk = _sinks(spark, "summaries")
    feed(spark, _epochs(spark, sf_dir), "epochs", F.col("epoch"), lambda src: stf.summaries_stream(src, out, chk, ["avg_loss", "val_loss"]))
    return finish(stf.latest_version(spark, out))


@register(
    "stream_epoch_metrics",
    q_runlog.RL + f"""SELECT run, CAST(floor(epoch_us(ts) / ({WINDOW_SECONDS} * 1000000.0)) * {WINDOW_SECONDS} AS BIGINT) AS window_start,
       round(avg(loss), 6) AS avg_loss, count(*) AS n FROM steps WHERE split = 'train' GROUP BY ALL""",
)
def stream_epoch_metrics(spark: SparkSession, sf_dir: str):
    out, chk = _sinks(spark, "windows")
    feed(spark, _steps(spark, sf_dir), "steps", _micros(), lambda src: stf.run_upserts(stf.epoch_metrics_stream(src), out, chk, ["run", "window_start"]))
    r = stf.read_upserts(spark, out, ["run", "window_start"])
    return finish(r.select("run", F.unix_seconds("window_start").alias("window_start"), "avg_loss", "n"))

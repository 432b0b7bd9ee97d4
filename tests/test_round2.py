"""Numerics with large offsets, ties, streams over months, hull in parallel."""

import datetime

from pyspark.sql import functions as F

from corpuslab.operators import stats, vectors
from corpuslab.plans import q_runlog, q_streams
from corpuslab.streaming import stateful


def test_offset_costs_no_digits(spark):
    df = spark.range(2000).select((F.lit(1e9) + F.col("id") / 1000).alias("x"), (F.col("id") / 1000).alias("y"))
    assert abs(stats.corr_matrix(df, ["x", "y"]).first()["corr"] - 1) < 1e-6
    fit = stats.ols(df, "y", ["x"])
    assert fit["rank"] == 2 and abs(fit["coef"][1] - 1) < 1e-6 and abs(fit["r2"] - 1) < 1e-6


def test_neighbours_of_equal_vectors(spark):
    same = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    out = vectors.cosine_knn(same.where("vec_id = 0"), same, n=3).orderBy("rank").collect()
    assert [r["nbr_id"] for r in out] == [1, 2, 3]


def test_hull_partitions_work_apart(spark):
    df = spark.range(0, 61 * 67, 1, 8).select((F.col("id") % 61).cast("double").alias("x"), (F.col("id") % 67).cast("double").alias("y"))
    out = stats.hull(df, "x", "y")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Coalesce 1" not in plan
    assert {(r["x"], r["y"]) for r in out.collect()} == {(0.0, 0.0), (60.0, 0.0), (0.0, 66.0), (60.0, 66.0)}


def test_streams_over_two_months_equal_batch(spark):
    start = datetime.datetime(2024, 1, 20)
    rows = [(i, i % 3, start + datetime.timedelta(hours=7 * i), float(i % 11)) for i in range(140)]
    ev = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, loss double").repartition(5)
    assert ev.where(F.dayofmonth("ts") == 31).count() > 0
    out, chk = q_streams._sinks(spark, "t-trigger")
    q_streams.feed(spark, ev.select("user_id", "event_id", "ts"), "t-events", q_streams._micros(),
                   lambda src: stateful.run_to_parquet(stateful.interval_trigger_stream(src, q_runlog.TRIGGER_US), out, chk))
    got = spark.read.parquet(out)
    fired = {(r["user_id"], r["event_id"]) for r in got.where("kind = 'fire'").collect()}
    want, last = set(), {}
    for e, u, t, _ in rows:
        if u not in last or (t - last[u]).total_seconds() * 1e6 >= q_runlog.TRIGGER_US:
            last[u] = t
            want.add((u, e))
    assert fired == want
    steps = ev.select(F.col("user_id").alias("run"), F.lit(1).alias("epoch"), "event_id", "ts", F.lit("train").alias("split"), "loss")
    out, chk = q_streams._sinks(spark, "t-windows")
    q_streams.feed(spark, steps, "t-steps", q_streams._micros(), lambda src: stateful.run_upserts(stateful.epoch_metrics_stream(src), out, chk, ["run", "window_start"]))
    assert stateful.read_upserts(spark, out, ["run", "window_start"]).agg(F.sum("n")).first()[0] == 140

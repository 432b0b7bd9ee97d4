import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from corpuslab.operators import runlog as rl
from corpuslab.plans import q_runlog, q_streams, views
from corpuslab.sources.tables import table
from corpuslab.streaming import stateful as stf


def _steps_rows(spark):
    ev = table(spark, SF_SMALL, "events")
    return ev.select(
        F.col("user_id").alias("run"), "event_id", "ts", "value", q_streams.epoch_col().alias("epoch"),
        F.when(F.col("event_type") == "view", F.lit("val")).otherwise(F.lit("train")).alias("split"),
        F.log(F.lit(1.0) + F.col("value")).alias("loss"),
    )


def _key(df, cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect())


def test_partial_loss_stream_equals_batch_with_restart(spark):
    rows = _steps_rows(spark)
    base = tempfile.mkdtemp(prefix="corpuslab-test-", dir="/tmp")
    src, out, chk = f"{base}/src", f"{base}/out", f"{base}/chk"
    for e in (1, 2):
        rows.where(F.col("epoch") == e).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    stf.run_to_parquet(stf.partial_loss_stream(stream(), 3), out, chk)
    for e in (3, 4, 5):
        rows.where(F.col("epoch") == e).coalesce(1).write.mode("append").parquet(src)
    stf.run_to_parquet(stf.partial_loss_stream(stream(), 3), out, chk)  # resumes from the checkpoint
    got = spark.read.parquet(out)
    want = rl.partial_loss(views.steps(spark, SF_SMALL), 3)
    cols = ["run", "epoch", "bucket", "partial_loss", "last_step"]
    assert _key(got, cols) == _key(want, cols)


def test_trigger_stream_reports_late_rows(spark):
    base = tempfile.mkdtemp(prefix="corpuslab-test-", dir="/tmp")
    src = f"{base}/src"
    schema = "user_id long, event_id long, ts timestamp_ntz"
    spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-01-01 07:00:00")], "user_id long, event_id long, ts string") \
        .select("user_id", "event_id", F.to_timestamp_ntz("ts").alias("ts")).coalesce(1).write.parquet(src)
    spark.createDataFrame([(1, 3, "2024-01-01 03:00:00")], "user_id long, event_id long, ts string") \
        .select("user_id", "event_id", F.to_timestamp_ntz("ts").alias("ts")).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    stf.run_to_parquet(stf.interval_trigger_stream(s, q_runlog.TRIGGER_US), f"{base}/out", f"{base}/chk")
    got = {(r["event_id"], r["kind"]) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {(1, "fire"), (2, "fire"), (3, "late")}


def test_plateau_stream_equals_batch(spark):
    res = q_streams.stream_plateau_lr(spark, SF_SMALL)
    want = q_runlog.plateau_lr(spark, SF_SMALL)
    assert _key(res, ["run", "epoch", "lr"]) == _key(want, ["run", "epoch", "lr"])


def _arrive(spark, base, slices, schema, run):
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/src")
        run(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"{base}/src"))


def test_late_steps_are_reported_and_change_no_bucket(spark):
    base = tempfile.mkdtemp(prefix="corpuslab-test-", dir="/tmp")
    row = lambda e, s, x: (7, 1, e, "train", x, s)
    schema = "run long, epoch int, event_id long, split string, loss double, sec long"
    slices = [[row(1, 10, 1.0), row(2, 20, 2.0)], [row(3, 15, 9.0), row(2, 20, 2.0), row(4, 30, 3.0), row(5, 40, 4.0)], [row(6, 50, 6.0)]]
    _arrive(spark, base, slices, schema, lambda src: stf.run_to_parquet(
        stf.partial_loss_stream(src.withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz")), 2), f"{base}/out", f"{base}/chk"))
    out = spark.read.parquet(f"{base}/out")
    assert sorted((r["bucket"], r["partial_loss"], r["last_step"]) for r in out.where("kind = 'bucket'").collect()) == [(0, 1.5, 2), (1, 3.5, 4)]
    assert sorted(r["event_id"] for r in out.where("kind = 'late'").collect()) == [2, 3]


def test_late_epochs_are_reported(spark):
    base = tempfile.mkdtemp(prefix="corpuslab-test-", dir="/tmp")
    slices = [[(1, 1, 3.0, 0.1), (1, 3, 2.0, 0.1)], [(1, 2, 9.0, 0.1), (1, 4, 2.5, 0.1)], [(1, 5, 2.5, 0.1), (1, 6, 2.5, 0.1)]]
    _arrive(spark, base, slices, "run long, epoch int, loss double, lr0 double", lambda src: stf.run_to_parquet(stf.plateau_lr_stream(src), f"{base}/out", f"{base}/chk"))
    out = spark.read.parquet(f"{base}/out")
    assert sorted((r["epoch"], r["lr"]) for r in out.where("kind = 'rate'").collect()) == [(1, 0.1), (3, 0.1), (4, 0.1), (5, 0.1), (6, 0.025)]
    assert [r["epoch"] for r in out.where("kind = 'late'").collect()] == [2]


def test_summaries_are_deltas_without_known_runs(spark):
    base = tempfile.mkdtemp(prefix="corpuslab-test-", dir="/tmp")
    known = spark.createDataFrame([(9,)], "run long")
    slices = [[(1, 1, 3.0), (2, 1, 4.0), (9, 1, 1.0)], [(1, 2, 2.0)], [(2, 3, 3.5), (1, 1, 8.0)]]
    _arrive(spark, base, slices, "run long, epoch int, val_loss double", lambda src: stf.summaries_stream(src, f"{base}/out", f"{base}/chk", ["val_loss"], known))
    assert sorted(map(tuple, stf.latest_version(spark, f"{base}/out").select("run", "epoch", "val_loss").collect())) == [(1, 2, 2.0), (2, 3, 3.5)]
    sizes = {r["v"]: r["count"] for r in spark.read.parquet(f"{base}/out").groupBy("v").count().collect()}
    assert sizes == {0: 2, 1: 1, 2: 2}  # a delta holds its own runs only


def test_state_calls_do_not_grow_with_keys(spark):
    """Thousands of keys of a few rows share a few state rows; null runs and epochs are keys of their own."""
    base = tempfile.mkdtemp(prefix="corpuslab-test-", dir="/tmp")
    schema = "run long, epoch int, event_id long, split string, loss double, sec long"
    runs = [*range(1500), 2**60 + 1, None]
    slices = [[(r, e, 10 * s + i, "train", float(i + s), 100 * s + i) for r in runs for e in (1, None) for i in (2, 1, 1)] for s in (0, 1)]
    _arrive(spark, base, slices, schema, lambda src: stf.run_to_parquet(
        stf.partial_loss_stream(src.withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz")), 3, buckets=4), f"{base}/out", f"{base}/chk"))
    out = spark.read.parquet(f"{base}/out")
    got = sorted(((r["run"], r["epoch"], r["bucket"], round(r["partial_loss"], 9), r["last_step"]) for r in out.where("kind = 'bucket'").collect()), key=str)
    assert got == sorted(((r, e, 0, round((1.0 + 2.0 + 2.0) / 3, 9), 3) for r in runs for e in (1, None)), key=str)
    late = out.where("kind = 'late'").groupBy("event_id").count().collect()
    assert {(r["event_id"], r["count"]) for r in late} == {(1, 2 * len(runs)), (11, 2 * len(runs))}
    assert spark.read.format("statestore").load(f"{base}/chk").count() <= 4


def test_rows_without_a_time_never_fire_and_hold_nothing_back(spark):
    base = tempfile.mkdtemp(prefix="corpuslab-test-", dir="/tmp")
    slices = [[(1, 1, 0), (1, 9, None), (1, 2, 3 * 3600), (2, 8, None)], [(1, 3, 7 * 3600), (2, 4, 8 * 3600)]]
    _arrive(spark, base, slices, "user_id long, event_id long, sec long", lambda src: stf.run_to_parquet(
        stf.interval_trigger_stream(src.withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz")), q_runlog.TRIGGER_US, buckets=2), f"{base}/out", f"{base}/chk"))
    got = {(r["user_id"], r["event_id"], r["kind"]) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {(1, 1, "fire"), (1, 9, "late"), (2, 8, "late"), (1, 3, "fire"), (2, 4, "fire")}

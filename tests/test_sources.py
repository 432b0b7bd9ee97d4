import json
import os
import tempfile

from corpuslab.sources import runlogs as rg


def _tmp():
    return tempfile.mkdtemp(prefix="corpuslab-test-", dir="/tmp")


def test_summary_csv_old_and_new_columns(spark):
    d = _tmp()
    with open(f"{d}/a.csv", "w") as f:
        f.write("activation,avg_loss,config_name,epoch,val_loss\nrelu,1.5,run_a,5.0,2.0\n")
    df = rg.scan_summary(spark, d)
    r = df.first()
    assert r["epoch"] == 5.0 and r["token_drift_cosine"] is None and r["val_loss"] == 2.0 and r["activation"] == "relu"


def test_summary_json_heterogeneous(spark):
    d = _tmp()
    os.makedirs(f"{d}/run1")
    os.makedirs(f"{d}/run2")
    json.dump({"model_type": "lstm_seq", "learning_rate": 0.001, "tinystories_weight": "0.8", "val_loss": 3.5}, open(f"{d}/run1/summary.json", "w"), indent=4)
    json.dump({"model_type": "lstm_seq", "learning_rate": "0.005", "tinystories_weight": "0.8"}, open(f"{d}/run2/summary.json", "w"), indent=4)
    rows = {r["run_dir"]: r for r in rg.scan_summary_json(spark, f"{d}/*/summary.json").collect()}
    assert rows["run1"]["learning_rate"] == 0.001 and rows["run2"]["learning_rate"] == 0.005
    assert rows["run1"]["tinystories_weight"] == 0.8 and rows["run2"]["val_loss"] is None


def test_generations_csv_multiline_and_jsonl(spark):
    d = _tmp()
    gen = spark.createDataFrame([("r1", "epoch_1.pt", "line one\nline \"two\"", "a"), ("r1", "epoch_2.pt", "x", "x[NN=['y']]")],
                                "run string, checkpoint string, generation string, annotation string")
    rg.write_generations(gen, d)
    c = rg.scan_generations_csv(spark, f"{d}/csv").orderBy("checkpoint").collect()
    j = rg.scan_generations_jsonl(spark, f"{d}/jsonl").orderBy("checkpoint").collect()
    assert [r["generation"] for r in c] == [r["generation"] for r in j] == ["line one\nline \"two\"", "x"]


def test_epoch_log_json(spark):
    log = json.dumps({"epoch_1": {"avg_loss": 2.0, "val_loss": 2.5}, "epoch_10": {"avg_loss": 1.0}, "notes": {}})
    df = spark.createDataFrame([("r", log)], "run string, log string")
    rows = sorted((r["epoch"], r["avg_loss"], r["val_loss"]) for r in rg.scan_epoch_log(df, "log").collect())
    assert rows == [(1, 2.0, 2.5), (10, 1.0, None)]


def test_run_listing_and_sinks(spark):
    d = _tmp()
    for run in ("b_run", "a_run"):
        os.makedirs(f"{d}/{run}")
        open(f"{d}/{run}/loss_log.pt", "w").write("x")
    runs = sorted(r["run_dir"] for r in rg.scan_runs(spark, d, "loss_log.pt").collect())
    assert runs == ["a_run", "b_run"]
    df = spark.createDataFrame([("m1", 1.0, "c1"), ("m2", 0.5, "c2")], "model_type string, val_loss double, config_name string")
    rg.append_summary(df, f"{d}/summary")
    rg.append_summary(df, f"{d}/summary")
    assert spark.read.parquet(f"{d}/summary").count() == 4
    v = rg.write_summary(df, f"{d}/merged")
    assert spark.read.parquet(v).count() == 2
    rg.export_top(df, f"{d}/top", 1, ["val_loss"])
    top = spark.read.option("header", True).csv(f"{d}/top").collect()
    assert [r["config_name"] for r in top] == ["c2"]

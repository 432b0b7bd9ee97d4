"""Frontier in several dimensions and versioned summaries."""

import tempfile

import numpy as np
import pytest

from corpuslab.operators import frontier as fr
from corpuslab.operators import runlog as rl
from corpuslab.sources import runlogs as rg


def _brute(m):
    return {i for i, p in enumerate(m) if not any((q <= p).all() and (q < p).any() for q in m)}


@pytest.mark.parametrize("shape", ["cube", "sphere", "ties"])
def test_skyline_equals_brute_force(spark, shape):
    rng = np.random.default_rng(4)
    m = rng.uniform(0, 1, (400, 3))
    if shape == "sphere":  # nearly all rows are on the front
        m = np.abs(rng.normal(size=(400, 3)))
        m /= np.linalg.norm(m, axis=1, keepdims=True)
    if shape == "ties":
        m = rng.integers(0, 5, (400, 3)).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b), float(-c)) for i, (a, b, c) in enumerate(m)], "id long, a double, b double, c double")
    got = [r["id"] for r in fr.skyline(df, ["a", "b"], ["c"], cells=27, piece=50).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(m)


def test_skyline_odd_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 0.0), (3, float("nan"), 0.0), (4, 1.0, 2.0), (5, 2.0, 2.0), (6, 0.0, 3.0), (7, -0.0, 3.0)], "id long, a double, b double")
    assert sorted(r["id"] for r in fr.skyline(df, ["a", "b"]).collect()) == [1, 4, 6, 7]
    assert [r["id"] for r in fr.skyline(df.where("id in (1, 5)"), ["a"], ["b"]).collect()] == [1]
    assert fr.skyline(df.where("id > 100"), ["a"], ["b"]).count() == 0


def test_a_version_counts_only_when_committed(spark):
    path = tempfile.mkdtemp(prefix="corpuslab-test-", dir="/tmp")
    with pytest.raises(FileNotFoundError):
        rg.read_summary(spark, path)
    one = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "config_name string, seq int, loss double")
    rg.write_summary(one, path)
    two = spark.createDataFrame([("b", 2, 0.5), ("c", 2, 3.0)], one.schema)
    rg.merge_summary(two, path, "config_name", "seq")
    # a writer that died after its rows, one that died with an empty commit, one in the middle of its line
    two.write.parquet(f"{path}/data-dead")
    open(f"{path}/_commits/000000000003", "w").close()
    with open(f"{path}/_commits/000000000004", "w") as f:
        f.write("data-de")
    rows = {r["config_name"]: r["loss"] for r in rg.read_summary(spark, path).collect()}
    assert rows == {"a": 1.0, "b": 0.5, "c": 3.0}
    assert {r["config_name"] for r in rg.read_summary(spark, path, 1).collect()} == {"a", "b"}
    rg.write_summary(one, path)
    assert list(rg.summary_versions(spark, path)) == [1, 2, 5]


def test_summarize_runs_isolates_rejects(spark):
    good = "lstm_seq_tsw0.8_bs128_lr0.001_actgelu_ep2_mlp5_k3_cs2_blk16_emb256_20250414_194725"
    names = spark.createDataFrame([(1, good), (2, good.replace("_actgelu", "")), (3, good.replace("lstm_seq", "foo")), (4, good), (5, None)], "run long, config_name string")
    epochs = spark.createDataFrame([(1, 1, 3.0, None), (1, 2, 2.0, 0.01), (2, 1, 9.0, None)], "run long, epoch int, val_loss double, learning_rate double")
    ok, bad = rl.summarize_runs(names, epochs)
    rows = {r["run"]: r for r in ok.collect()}
    assert set(rows) == {1, 4} and rows[1]["val_loss"] == 2.0 and rows[1]["learning_rate"] == 0.01
    assert rows[4]["val_loss"] is None and rows[4]["learning_rate"] == 0.001 and rows[4]["k"] == 3
    rejects = {r["run"]: r["missing"] for r in bad.collect()}
    assert rejects[2] == "activation" and rejects[3] == "model_type" and set(rejects) == {2, 3, 5}

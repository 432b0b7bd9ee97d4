"""Pluggable scorers against the models that they stand for."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import kgram as lm
from corpuslab.operators import scorer


def test_count_scorer_equals_count_model(spark, monkeypatch):
    monkeypatch.setattr(scorer, "SLICE_BYTES", 400)  # many slices
    rng = np.random.default_rng(3)
    pairs = [(int(d), f"c{min(a, 9)}", int(b)) for d, a, b in zip(rng.integers(0, 6, 400), rng.geometric(0.4, 400), rng.geometric(0.3, 400))]
    train = spark.createDataFrame(pairs, "doc long, ctx string, nxt int")
    held = spark.createDataFrame([*pairs[::3], (7, "unseen", 1), (7, "c1", 999), (7, None, 2)], "doc long, ctx string, nxt int")
    counts = lm.fit_counts(train)
    ctxs = lm.context_table(counts)
    want = {(r["doc"], r["ctx"], r["nxt"]): (r["m"], r["n"], r["nll"]) for r in lm.score(held, counts, ctxs, 50, 0.5, by=["doc"]).collect()}
    rows = held.groupBy("doc", "ctx", "nxt").agg(F.count(F.lit(1)).alias("m")).join(ctxs.select("ctx", "C"), "ctx", "left")
    got = scorer.score_keyed(rows, counts, ["ctx", "nxt"], scorer.CountScorer(50, 0.5)).collect()
    assert len(got) == len(want)
    for r in got:
        m, n, nll = want[r["doc"], r["ctx"], r["nxt"]]
        assert (r["m"], r["n"]) == (m, n) and abs(r["nll"] - nll) < 1e-12
    none = scorer.score_keyed(rows.where("false"), counts, ["ctx", "nxt"], scorer.CountScorer(50))
    assert none.count() == 0 and none.columns == [*rows.columns, "n", "p", "nll"]


def test_tree_scorer_equals_model(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor

    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (80, 3)).round(2)
    df = spark.createDataFrame([(i, *map(float, v), float(v[0] * v[1] + abs(v[2]))) for i, v in enumerate(x)], "id long, a double, b double, c double, y double")
    feats = ["a", "b", "c"]
    data = VectorAssembler(inputCols=feats, outputCol="features").transform(df)
    for learner in (GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, seed=1), DecisionTreeRegressor(labelCol="y", maxDepth=4)):
        model = learner.fit(data)
        want = {r["id"]: r["prediction"] for r in model.transform(data).collect()}
        got = {r["id"]: r["pred"] for r in scorer.score_rows(df, scorer.TreeScorer(model, feats), ["id"]).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    zeros = spark.createDataFrame([(1, None, None, None), (2, 0.0, 0.0, 0.0)], "id long, a double, b double, c double")
    a, b = scorer.score_rows(zeros, scorer.TreeScorer(model, feats), ["id"]).orderBy("id").collect()
    assert a["pred"] == b["pred"]


def test_scorer_contract(spark):
    class Short:
        columns, schema = ("a",), "s double"

        def score(self, batch, model=None):
            return pd.DataFrame({"s": []})


    rows = spark.createDataFrame([(1, 2.0)], "id long, a double")
    with pytest.raises(Exception, match="0 rows for 1"):
        scorer.score_rows(rows, Short(), ["id"]).collect()
    with pytest.raises(ValueError, match="every task"):
        scorer.score_rows(rows, scorer_with_table(), ["id"], max_bytes=500)
    with pytest.raises(ValueError, match="kept"):
        scorer.score_rows(rows.withColumnRenamed("id", "pred"), scorer_with_table(), ["pred"])


def scorer_with_table():
    s = object.__new__(scorer.TreeScorer)
    s.columns, s.trees = ("a",), [(1.0, np.zeros((100, 4)))]
    return s

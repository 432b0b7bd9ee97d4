"""Exact tree attribution against the sum over all subsets, Student quantiles, guards."""

from itertools import combinations
from math import factorial

import numpy as np

from corpuslab.operators import stats as st


def test_tree_attribution_equals_all_subsets(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(8)
    x = rng.uniform(0, 1, (60, 4)).round(2)
    y = 2 * x[:, 0] - x[:, 1] + 3 * x[:, 0] * x[:, 2] + (x[:, 3] > 0.5)
    feats = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, y double")
    model = GBTRegressor(labelCol="y", maxIter=3, maxDepth=3, seed=1).fit(VectorAssembler(inputCols=feats, outputCol="features").transform(df))
    got = {(r["id"], r["feature"]): r for r in st.tree_attribution(df, model, feats, "id").collect()}
    assert len(got) == 240

    def value(node, row, known, rows):  # expected output when only the known features are read
        if node.subtreeDepth() == 0:
            return node.prediction()
        f, th = node.split().featureIndex(), node.split().threshold()
        left = [r for r in rows if x[r][f] <= th]
        right = [r for r in rows if x[r][f] > th]
        if f in known:
            return value(node.leftChild(), row, known, left) if row[f] <= th else value(node.rightChild(), row, known, right)
        return (len(left) * value(node.leftChild(), row, known, left) + len(right) * value(node.rightChild(), row, known, right)) / len(rows)

    roots = [(w, t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees)]
    for i in (0, 7, 23):
        f_of = {k: sum(w * value(root, x[i], set(k), range(60)) for w, root in roots) for m in range(5) for k in combinations(range(4), m)}
        for j, name in enumerate(feats):
            others = [o for o in range(4) if o != j]
            phi = sum(factorial(m) * factorial(3 - m) / 24 * (f_of[tuple(sorted((*k, j)))] - f_of[k]) for m in range(4) for k in combinations(others, m))
            assert abs(got[i, name]["phi"] - phi) < 1e-9
        assert abs(got[i, "a"]["pred"] - f_of[(0, 1, 2, 3)]) < 1e-9 and abs(got[i, "a"]["base"] - f_of[()]) < 1e-9
    for i in range(60):
        assert abs(sum(got[i, f]["phi"] for f in feats) - got[i, "a"]["pred"] + got[i, "a"]["base"]) < 1e-9


def test_student_quantiles():
    # fixed values: two-sided 95% points of the t table
    for dof, q in ((1, 12.7062), (4, 2.7764), (10, 2.2281), (60, 2.0003), (1000, 1.9623)):
        assert abs(st.t_quantile(0.95, dof) - q) < 1e-4


def test_intervals_and_guards(spark):
    rng = np.random.default_rng(2)
    x, e = rng.normal(size=40), rng.normal(size=40)
    df = spark.createDataFrame([(i, float(a), float(1 + 2 * a + b)) for i, (a, b) in enumerate(zip(x, e))], "id long, x double, y double")
    fit = st.ols(df, "y", ["x"])
    rows = {r["term"]: r for r in st.coef_frame(spark, fit).collect()}
    design = np.column_stack([np.ones(40), x])
    beta = np.linalg.lstsq(design, 1 + 2 * x + e, rcond=None)[0]
    res = 1 + 2 * x + e - design @ beta
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * (res @ res) / 38)
    for i, term in enumerate(("Intercept", "x")):
        assert np.allclose([rows[term][c] for c in ("coef", "se", "ci_low", "ci_high")], [beta[i], se[i], beta[i] - 2.024394 * se[i], beta[i] + 2.024394 * se[i]], atol=1e-6)
    assert st.report_frame(spark, st.ols(df.where("id < 4"), "y", ["x"])).count() == 0
    assert st.report_frame(spark, st.ols(df.where("id < 5"), "y", ["x"])).count() == 1
    assert st.hull(df.where("id < 2"), "x", "y").count() == 0
    assert st.hull(df.where("id < 3"), "x", "y").count() == 3

import numpy as np
from pyspark.sql import functions as F

from corpuslab.operators import stats as st


def test_constant_column_corr_is_null(spark):
    df = spark.createDataFrame([(float(i), 0.8, float(i * 2 + 1)) for i in range(10)], "x double, c double, y double")
    out = {(r["a"], r["b"]): r["corr"] for r in st.corr_matrix(df, ["x", "c", "y"]).collect()}
    assert out[("x", "c")] is None and out[("c", "y")] is None and abs(out[("x", "y")] - 1.0) < 1e-12


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(0)
    n = 200
    emb = rng.choice([32, 64, 128, 256], n)
    act = rng.choice(["gelu", "relu"], n)
    y = 5.0 - 0.01 * emb + 0.5 * (act == "relu") + rng.normal(0, 0.3, n)
    df = spark.createDataFrame([(i, float(a), str(b), float(c)) for i, (a, b, c) in enumerate(zip(emb, act, y))],
                               "run long, embed_size double, activation string, val_loss double")
    fit = st.ols(df, "val_loss", ["embed_size"], "activation", order_col="run")
    X = np.column_stack([np.ones(n), (act == "relu").astype(float), emb])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    assert np.allclose(fit["coef"], beta, atol=1e-9)
    resid = y - X @ beta
    r2 = 1 - resid @ resid / ((y - y.mean()) @ (y - y.mean()))
    assert abs(fit["r2"] - r2) < 1e-9
    dw = np.sum(np.diff(resid) ** 2) / (resid @ resid)
    assert abs(fit["dw"] - dw) < 1e-9
    assert 0 <= fit["p"][2] < 1e-6


def test_ols_rank_deficient_min_norm(spark):
    df = spark.createDataFrame([(float(e), "gelu", float(y)) for e, y in [(32, 1.0), (64, 2.0), (128, 2.5), (256, 4.0)]],
                               "embed_size double, activation string, val_loss double")
    fit = st.ols(df, "val_loss", ["embed_size"], "activation")
    X = np.column_stack([np.ones(4), [32, 64, 128, 256]])
    beta = np.linalg.pinv(X) @ np.array([1.0, 2.0, 2.5, 4.0])
    assert fit["terms"] == ["Intercept", "embed_size"] and np.allclose(fit["coef"], beta)


def _brute_skyline(pts):
    keep = []
    for i, (l, a) in enumerate(pts):
        dom = any(l2 <= l and a2 >= a and (l2 < l or a2 > a) for j, (l2, a2) in enumerate(pts) if j != i)
        if not dom:
            keep.append((l, a))
    return sorted(keep)


def test_skyline_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [(float(round(x, 2)), float(round(y, 2))) for x, y in rng.uniform(0, 1, (300, 2))]
    pts += [pts[0], (pts[1][0], pts[1][1] - 0.5)]
    df = spark.createDataFrame(pts, "loss double, acc double")
    got = sorted((r["loss"], r["acc"]) for r in st.skyline_2d(df, "loss", "acc").collect())
    assert got == _brute_skyline(pts)


def test_hull_contains_extremes(spark):
    rng = np.random.default_rng(2)
    pts = rng.uniform(0, 1, (500, 2))
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "x double, y double").repartition(4)
    got = sorted((r["x"], r["y"]) for r in st.hull(df, "x", "y").collect())
    want = sorted(map(tuple, st._chain(pts).tolist()))
    assert got == want
    for p in [pts[pts[:, 0].argmin()], pts[pts[:, 0].argmax()], pts[pts[:, 1].argmin()], pts[pts[:, 1].argmax()]]:
        assert tuple(p) in got


def test_box_stats_quartiles(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    s, o = st.box_stats(df, ["g"], "v")
    r = s.first()
    q = np.percentile(vals, [25, 50, 75])
    assert (r["q25"], r["q50"], r["q75"]) == tuple(q) and r["hi_whisker"] == 4.0 and r["n_outliers"] == 1
    assert [x["v"] for x in o.collect()] == [100.0]


def test_quantiles_equal_numpy_with_ties_and_null_groups(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 3 else "cold", float(v)) for i, v in enumerate(rng.normal(size=900))]
    rows += [("hot", 0.5)] * 400 + [(None, 2.0), (None, 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["q25"], r["q50"], r["q75"], r["n"]) for r in st.quantiles(df, ["g"], "v").collect()}
    assert got.keys() == {"hot", "cold", None}
    for k in got:
        v = [y for x, y in rows if x == k]
        assert np.allclose(got[k], [*np.percentile(v, [25, 50, 75]), len(v)], rtol=0, atol=1e-12)
    whole = st.quantiles(df, [], "v", (0.5,)).first()
    assert abs(whole["q50"] - np.median([y for _, y in rows if y is not None])) < 1e-12


def test_shapley_contributions_add_up(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(b), float(c), float(2 * a - b + 0.5 * a * c)) for i, (a, b, c) in enumerate(rng.uniform(0, 1, (80, 3)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    feats = ["a", "b", "c"]
    model = GBTRegressor(labelCol="y", maxIter=10, maxDepth=3, seed=1).fit(VectorAssembler(inputCols=feats, outputCol="features").transform(df))
    phi = st.shapley_permutation(df, model, feats, "id", n_perm=4)
    sums = phi.groupBy("id", "pred", "base").agg(F.sum("phi").alias("s")).collect()
    assert len(sums) == 80
    assert all(abs(r["s"] - (r["pred"] - r["base"])) < 1e-9 for r in sums)

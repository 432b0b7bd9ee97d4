import numpy as np

from corpuslab.operators import vectors as vx


def test_cosine_knn_exact(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {(r["qid"], r["rank"]): r["nbr_id"] for r in vx.cosine_knn(df, df, 5, block=64).collect()}
    mn = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = mn @ mn.T
    np.fill_diagonal(sims, -np.inf)
    for q in range(300):
        order = np.lexsort((np.arange(300), -sims[q]))[:5]
        assert [got[(q, k + 1)] for k in range(5)] == list(order)


def test_cosine_knn_exchanges_hits_and_no_vectors(spark):
    rng = np.random.default_rng(4)
    m = rng.integers(-2, 3, size=(200, 4)).astype(np.float32) + np.float32(0.25)  # many ties, some at the last place
    df = spark.createDataFrame([(i * 3, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(3)
    out = vx.cosine_knn(df, df, 4, block=16, table_block=32)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.count("Exchange hashpartitioning") == 1
    got = {(r["qid"], r["rank"]): (r["nbr_id"], r["sim"]) for r in out.collect()}
    first = {(r["qid"], r["rank"]): r["sim"] for r in vx.cosine_knn(df, df, 4, drop="first").collect()}
    x = m.astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    for q in range(200):
        want = np.sort(np.delete(sims[q], q))[::-1][:4]
        assert np.allclose([got[(q * 3, k + 1)][1] for k in range(4)], want) and q * 3 not in [got[(q * 3, k + 1)][0] for k in range(4)]
        assert np.allclose([first[(q * 3, k + 1)] for k in range(4)], np.sort(sims[q])[::-1][1:5])
    assert len(got) == len(first) == 800


def test_pool_mean_and_norms(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [3.0, 4.0])], "vec_id long, label int, embedding array<double>")
    pm = {r["dim"]: r["value"] for r in vx.pool_mean(df, "label", "embedding").collect()}
    assert pm == {1: 2.0, 2: 3.0}
    n = df.select(vx.l2_normalize("embedding").alias("v")).collect()
    assert np.allclose([np.linalg.norm(r["v"]) for r in n], 1.0)

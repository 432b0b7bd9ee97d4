"""Bucketed neighbours against brute force: recall, hot buckets, odd rows, probes."""

import numpy as np

from corpuslab.operators import neighbours as nb

SCHEMA = "vec_id long, embedding array<double>"


def _rows(m):
    return [(i, [float(x) for x in v]) for i, v in enumerate(m)]


def _brute(m, n):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -np.inf)
    return [set(np.lexsort((np.arange(len(m)), -s))[:n]) for s in sims]


def test_recall_reaches_the_target(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    m = centres[rng.integers(0, 40, 1500)] + 0.4 * rng.normal(size=(1500, 24))
    df = spark.createDataFrame(_rows(m), SCHEMA)
    got = {}
    for r in nb.cosine_knn_lsh(df, df, 5, bucket=32).collect():
        assert 0.9 <= r["recall"] <= 1.0
        got.setdefault(r["qid"], set()).add(r["nbr_id"])
    truth = _brute(m, 5)
    assert all(len(got.get(i, ())) <= 5 and i not in got.get(i, ()) for i in range(1500))
    assert sum(len(truth[i] & got.get(i, set())) for i in range(1500)) >= 0.88 * 5 * 1500


def test_hot_bucket_is_compared_in_pieces(spark):
    rng = np.random.default_rng(6)
    m = np.vstack([np.tile(rng.normal(size=16), (150, 1)) + 1e-3 * rng.normal(size=(150, 16)), rng.normal(size=(150, 16))])
    df = spark.createDataFrame(_rows(m), SCHEMA)
    truth = _brute(m, 3)
    got = {}
    for r in nb.cosine_knn_lsh(df, df, 3, target=1.0, bucket=16, block=20, table_block=30).collect():
        got.setdefault(r["qid"], set()).add(r["nbr_id"])
    assert got == dict(enumerate(truth))


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, []), (None, [1.0, 0.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["qid"], r["nbr_id"]) for r in nb.cosine_knn_lsh(df, df, 5).collect()) == [(1, 2), (2, 1)]
    empty = df.where("vec_id > 100")
    assert nb.cosine_knn_lsh(df, empty, 5).count() == 0
    assert nb.cosine_knn_lsh(empty, df, 5).count() == 0


def test_probes_are_distinct_and_all_probes_are_everything():
    margins = np.random.default_rng(1).normal(size=(7, 5))
    codes = nb.probed(margins, 32)
    assert all(sorted(c) == list(range(32)) for c in codes)
    few = nb.probed(margins, 4)
    assert all(len(set(c)) == 4 for c in few) and (few[:, 0] == nb.probed(margins, 1)[:, 0]).all()


def test_plan_widens_to_the_exact_search():
    plan, steps = nb.start_plan(10**6), 0
    while not plan.whole:
        plan, steps = plan.wider(), steps + 1
    assert steps < 40 and nb.start_plan(10**6).bits == 11


def test_vectors_without_neighbours_are_not_sent_to_every_bucket(spark, monkeypatch):
    plans, search = [], nb._candidates
    monkeypatch.setattr(nb, "_candidates", lambda q, t, dim, plan, *rest: plans.append(plan) or search(q, t, dim, plan, *rest))
    m = np.random.default_rng(8).normal(size=(1500, 32))
    df = spark.createDataFrame(_rows(m), SCHEMA)
    got = {}
    for r in nb.cosine_knn_lsh(df, df, 5, bucket=16, block=400, table_block=600).collect():
        assert r["recall"] == 1.0
        got.setdefault(r["qid"], set()).add(r["nbr_id"])
    assert got == dict(enumerate(_brute(m, 5)))
    assert len(plans) == 1 and plans[0].copies <= nb.COPIES  # before: the table for each plan tried, then a query for each bucket

"""Class-factored k-gram network: classes cover the ids, probabilities add up, learns what follows."""

import numpy as np
from pyspark.sql import functions as F

from corpuslab.operators import classlm as cm


def test_classes_are_ranges_that_cover_all_ids(spark):
    v = 37
    ids = spark.range(1, v + 1).select("id", cm.token_class(F.col("id")).alias("c")).collect()
    by_class = {}
    for r in ids:
        by_class.setdefault(r["c"], []).append(r["id"])
    assert [r["c"] for r in ids][:12] == [0, 1, 2, 3, 3, 4, 4, 5, 5, 5, 5, 6]
    assert sorted(by_class) == list(range(max(by_class) + 1))
    got = {r["c"]: (r["f"], r["s"]) for r in spark.range(max(by_class) + 1).select(
        F.col("id").alias("c"), cm.class_first(F.col("id")).alias("f"), cm.class_size(F.col("id"), v).alias("s")).collect()}
    assert got == {c: (min(x), len(x)) for c, x in by_class.items()}


def test_probabilities_of_all_tokens_add_up_and_rare_tokens_are_predicted(spark):
    rng = np.random.default_rng(3)
    v = 23
    seqs = []
    for _ in range(60):  # token 2t follows token t, with noise
        t, seq = int(rng.integers(1, v + 1)), []
        for _ in range(12):
            seq.append(t)
            t = t * 2 % v + 1 if rng.uniform() < 0.9 else int(rng.integers(1, v + 1))
        seqs.append(seq)
    rows = [([s[i - 1], s[i]], s[i + 1]) for s in seqs for i in range(1, len(s) - 1)]
    train = spark.createDataFrame(rows, "ctx_arr array<int>, nxt int")
    model = cm.fit(train, 2, v, max_iter=60)
    ask = spark.createDataFrame([(i, list(ctx), t) for i, ctx in enumerate([(1, 3), (9, 19), (0, 5), (22, 22)]) for t in range(1, v + 1)], "q int, ctx_arr array<int>, nxt int")
    sums = cm.score(model, ask, ["q"]).groupBy("q").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert len(sums) == 4 and all(abs(r["s"] - 1) < 1e-9 and r["n"] == v for r in sums)
    e = cm.evaluate(cm.score(model, train.withColumn("g", F.lit(1)), ["g"]), ["g"]).first()
    assert e["n"] == len(rows) and e["accuracy"] > 0.6 and e["cross_entropy"] < np.log(v)


def test_numpy_network_equals_spark_ml(spark):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import FeatureHasher
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(4)
    ctx = [np.r_[0, 9, 10, 99, 12345, 2**31 - 1, rng.integers(0, 10**7, 60)].astype(np.int32) for _ in range(2)]
    df = spark.createDataFrame([(i, str(a), str(b), float(i % 5)) for i, (a, b) in enumerate(zip(*ctx))], "i int, c0 string, c1 string, label double")
    x = FeatureHasher(inputCols=["c0", "c1"], outputCol="features", numFeatures=64).transform(df)
    net = MultilayerPerceptronClassifier(layers=[64, cm.HIDDEN, 5], maxIter=5, seed=1).fit(x)
    rows = net.transform(x).orderBy("i").select("features", vector_to_array("probability").alias("p")).collect()
    for i, r in enumerate(rows):
        got = sorted(int(cm.hashed(f"c{j}", c[i : i + 1], 64)[0]) for j, c in enumerate(ctx))
        assert set(got) == set(r["features"].indices)
    probs = np.concatenate(list(cm.class_probabilities(net.weights.toArray(), ctx, 64, 5)))
    assert np.allclose(probs, [r["p"] for r in rows], atol=1e-9)


def test_hot_last_tokens_and_rare_counts_give_the_same_scores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = 40
    rows = [([int(a), int(rng.choice([1, 1, 1, 2, 3]))], int(b)) for a, b in zip(rng.integers(0, v + 1, 900), np.minimum(rng.geometric(0.1, 900), v))]
    train = spark.createDataFrame(rows, "ctx_arr array<int>, nxt int")
    model = cm.fit(train, 2, v, max_iter=3)
    key = lambda df: sorted((r["g"], r["c0"], r["c1"], r["nxt"], r["m"], round(r["p"], 12), r["hit"]) for r in df.collect())
    asked = train.withColumn("g", F.when(F.col("nxt") % 2 == 0, "a"))
    asked = asked.withColumn("g", F.coalesce("g", F.lit("b")))
    whole = key(cm.score(model, asked, ["g"]))
    monkeypatch.setattr(cm.grams, "SLICE", 50)
    monkeypatch.setattr(cm.grams, "CHUNK", 100)
    monkeypatch.setattr(cm, "HEAD", 3)
    assert key(cm.score(model, asked, ["g"])) == whole and sum(r[4] for r in whole) == len(rows)


def test_training_pairs_are_merged_before_a_slice_of_last_tokens_holds_them(spark, monkeypatch):
    taken = []
    real = cm.grams.counts
    monkeypatch.setattr(cm.grams, "counts", lambda dealt, k: taken.append((k, dealt)) or real(dealt, k))
    rows = [([1, 1 + i % 2], 1 + i % 3) for i in range(600)]
    train = spark.createDataFrame(rows, "ctx_arr array<int>, nxt int").repartition(4)
    model = cm.fit(train, 2, 5, max_iter=1)
    pairs = [d for k, d in taken if k == 1][0]
    assert pairs.agg(F.sum("n")).first()[0] == 6  # each pair once, not once for each task that saw it
    assert {(r["last"], r["nxt"]): r["n"] for r in model.pairs.collect()} == {(1 + i % 2, 1 + i % 3): 100 for i in range(6)}


def test_counts_of_frequent_tokens_reach_the_driver_packed(spark):
    tokens = spark.range(1, 5001).select(F.col("id").cast("int").alias("nxt"), (F.col("id") * 3).alias("c")).repartition(3)
    rows = list(cm._collected(tokens))
    assert len(rows) == 3  # one a batch, not one a token
    got = {}
    for r in rows:
        got.update(zip(cm.grams._values([r["nxt"]], [r["n"]], np.int32).tolist(), cm.grams._values([r["c"]], [r["n"]], np.int64).tolist()))
    assert got == {i: 3 * i for i in range(1, 5001)}


def test_a_slice_is_scored_in_parts(spark, monkeypatch):
    rows = [([i % 7, 1 + i % 3], 1 + (i * i) % 11) for i in range(400)]
    train = spark.createDataFrame(rows, "ctx_arr array<int>, nxt int")
    model = cm.fit(train, 2, 12, max_iter=1)
    key = lambda: sorted((r["c0"], r["c1"], r["nxt"], r["m"], round(r["p"], 12), r["hit"]) for r in cm.score(model, train).collect())
    whole = key()
    monkeypatch.setattr(cm, "SCORED", 10)
    assert key() == whole and sum(r[3] for r in whole) == 400

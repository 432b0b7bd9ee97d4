from pyspark.sql import functions as F

from corpuslab.functions import scalars as sc
from corpuslab.operators import runlog as rl


def test_plateau_fixture(spark):
    df = spark.createDataFrame([(1, e + 1, l) for e, l in enumerate([3.0, 2.0, 2.0, 2.0, 2.0, 2.0])], "run long, epoch int, avg_loss double")
    out = rl.plateau_lr(df.withColumn("lr0", F.lit(1.0)), F.col("lr0")).orderBy("epoch").collect()
    assert [r["lr"] for r in out] == [1.0, 1.0, 1.0, 1.0, 0.25, 0.25]


def test_partial_loss_fixture(spark):
    df = spark.createDataFrame([(1, 1, "train", s, float(s)) for s in range(1, 8)], "run long, epoch int, split string, step long, loss double")
    out = rl.partial_loss(df, 3).orderBy("bucket").collect()
    assert [r["partial_loss"] for r in out] == [2.0, 5.0]


def test_interval_trigger_fixture(spark):
    secs = [0, 10, 59, 61, 100, 125]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(secs)], "user_id long, event_id long, t long")
    out = rl.interval_trigger(df, "user_id", F.col("t"), 60).orderBy("t").collect()
    assert [r["t"] for r in out] == [0, 61, 125]


def test_interval_trigger_matches_a_plain_fold(spark):
    import random

    rnd = random.Random(5)
    rows = []
    for user in range(3):
        t = 0
        for i in range(200 if user == 0 else 20):
            t += rnd.choice([1, 5, 20, 60, 61])
            rows.append((user, user * 1000 + i, t))
    df = spark.createDataFrame(rows, "user_id long, event_id long, t long")
    a = sorted(tuple(r) for r in rl.interval_trigger(df, "user_id", F.col("t"), 60).collect())
    b, due = [], {}
    for user, event, t in rows:
        if t >= due.get(user, t):
            due[user] = t + 60
            b.append((user, t, event))
    assert a == sorted(b) and len(a) > 10


def test_merge_last_wins_fixture(spark):
    df = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("a", 3, 30)], "key string, seq int, v int")
    out = {r["key"]: (r["v"], r["first_seq"]) for r in rl.merge_last_wins(df, "key", "seq", ["v"]).collect()}
    assert out == {"a": (30, 1), "b": (20, 2)}


def test_merge_override(spark):
    cfg = spark.createDataFrame([(1, 0.1, "x")], "run long, lr double, m string")
    met = spark.createDataFrame([(1, None, 2.0)], "run long, lr double, loss double")
    a = rl.merge_override(cfg, met, "run").first()
    b = rl.merge_override(cfg, met, "run", null_overrides=True).first()
    assert (a["lr"], a["loss"], a["m"]) == (0.1, 2.0, "x") and b["lr"] is None


NAME = "kgram_mlp_seq_tsw0.8_bs128_lr0.001_actgelu_ep2_mlp5_k3_cs2_blk16_emb256_20250414_194725"


def test_config_parse_fixtures(spark):
    names = [NAME, NAME[:-16], NAME.replace("lr0.001", "lr1e-05"), "foo" + NAME[len("kgram_mlp_seq"):],
             NAME.replace("_actgelu", ""), NAME.replace("_k3_", "_k2_").replace("blk16", "blk64")]
    df = spark.createDataFrame([(n,) for n in names], "config_name string")
    ok, bad = rl.parse_runs(df)
    okd = {r["config_name"]: r for r in ok.collect()}
    badd = {r["config_name"]: r["missing"] for r in bad.collect()}
    r = okd[NAME]
    assert (r["model_type"], r["tinystories_weight"], r["batch_size"], r["learning_rate"], r["activation"], r["num_epochs"],
            r["inner_layers"], r["k"], r["chunk_size"], r["block_size"], r["embed_size"]) == (
        "kgram_mlp_seq", 0.8, 128, 0.001, "gelu", 2, 5, 3, 2, 16, 256)
    assert NAME[:-16] in okd
    assert badd[names[2]] == "learning_rate" and badd[names[3]] == "model_type" and badd[names[4]] == "activation"
    r6 = okd[names[5]]
    assert (r6["k"], r6["block_size"]) == (2, 64)


def test_core_config_safe_name_basename(spark):
    df = spark.createDataFrame([(NAME, 'a: b<c>"d/e\\f|g?h*i', "C:\\runs\\x/y.pt")], "n string, s string, p string")
    r = df.select(sc.core_config("n").alias("c"), sc.safe_name("s").alias("s"), sc.basename("p").alias("b")).first()
    assert r["c"] == NAME[:-16] and r["s"] == "a-bcdefghi" and r["b"] == "y.pt"


def test_config_name_roundtrip(spark):
    df = spark.createDataFrame([(5,)], "run long").withColumn("epoch", F.lit(3)).select("run", "epoch", *sc.synthetic_config("run"))
    named = df.withColumn("config_name", sc.config_name())
    ok, bad = rl.parse_runs(named.select("config_name"))
    assert bad.count() == 0 and ok.first()["k"] == 1


def test_dedup_columns_first_wins(spark):
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    b = spark.createDataFrame([(1, "y")], "k long, v string")
    j = a.join(b, a["k"] == b["k"])
    d = rl.dedup_columns(j)
    assert d.columns == ["k", "v"] and d.first()["v"] == "x"


def test_step_statistics(spark):
    from corpuslab.operators import runlog as rl

    rows = [(1, 1, 1, 3.0), (1, 1, 2, 1.0), (1, 1, 3, 8.0), (1, 1, 4, None), (2, 1, 1, 0.5)]
    df = spark.createDataFrame(rows, "run long, epoch int, step int, norm double")
    got = {r["run"]: r for r in rl.step_statistics(df, "norm", 2.0, ["step"]).collect()}
    r = got[1]
    assert r["n_steps"] == 3 and r["grad_norm_preclip"] == 4.0 and r["max_grad_norm"] == 8.0
    assert abs(r["grad_norm_postclip"] - 5.0 / 3) < 1e-5 and abs(r["grad_norm"] - 2.0) < 1e-5
    assert got[2]["grad_norm"] == 0.5 and rl.step_statistics(df.where("run > 5"), "norm", 2.0, ["step"]).count() == 0

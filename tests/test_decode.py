import hashlib
import math
import random
import re

import pytest

from pyspark.sql import functions as F

from corpuslab.operators import decode as dc


def test_repetition_penalty_sign_rule(spark):
    df = spark.createDataFrame([(i, float(l)) for i, l in enumerate([2, 1, 0, -1])], "id int, logit double")
    seen = F.col("id").isin(0, 3)
    out = [round(r["p"], 6) for r in df.select(dc.repetition_penalty(F.col("logit"), seen, 1.5).alias("p")).orderBy(F.monotonically_increasing_id()).collect()]
    assert out == [1.333333, 1.0, 0.0, -1.5]


def _cands(spark, probs):
    return spark.createDataFrame([(0, i, math.log(p)) for i, p in enumerate(probs)], "ctx int, nxt int, logit double")


def test_nucleus_edges(spark):
    c = _cands(spark, [0.5, 0.3, 0.2])
    assert dc.nucleus(c, 0.5, 1.0).count() == 2
    assert dc.nucleus(c, 0.4, 1.0).count() == 1
    assert dc.nucleus(c, 1.0, 1.0).count() == 3
    kept = dc.nucleus(c, 0.5, 1.0).agg(F.sum("p_keep")).first()[0]
    assert abs(kept - 1.0) < 1e-7


def test_softmax_sums_to_one_and_draw_in_nucleus(spark):
    rows = [(ctx, nxt, float(1 + (ctx * 7 + nxt) % 5)) for ctx in range(20) for nxt in range(30)]
    c = spark.createDataFrame(rows, "ctx int, nxt int, logit double")
    s = dc.softmax(c, temperature=0.8).groupBy("ctx").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in s)
    kept = dc.nucleus(c, 0.9, 0.8)
    drawn = dc.draw_from(kept, 42)
    assert drawn.join(kept, ["ctx", "nxt"], "left_anti").count() == 0 and drawn.count() == 20


def test_greedy_generation_chain(spark):
    cands = spark.createDataFrame([(1, 2, 5, 0.0), (1, 3, 5, 0.0), (2, 1, 1, 0.0)], "ctx int, nxt int, n long, logit double")
    cands = cands.withColumn("logit", F.log(F.col("n").cast("double")))
    prompts = spark.createDataFrame([(10, 1), (11, 9)], "pid long, ctx int")
    g = {(r["pid"], r["step"]): r["token"] for r in dc.generate(prompts, cands, 3, "greedy", fallback=1).collect()}
    assert [g[(10, s)] for s in (1, 2, 3)] == [2, 1, 2]  # tie 2 vs 3 -> smaller id
    assert [g[(11, s)] for s in (1, 2, 3)] == [1, 2, 1]  # unseen context falls back to id 1


def test_queries_generate_the_length_of_the_reference(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    steps = __spark_entry__.queries()["generate_greedy"](spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("step").alias("last")).collect()
    assert steps and {(r["n"], r["last"]) for r in steps} == {(20, 20)}


def _u(key):
    return int(hashlib.md5(f"42|{key}".encode()).hexdigest()[:8], 16) / 2**32


def plain_step(pid, step, ctx, cands, seen, top_p, t, penalty):
    """One draw over all successors of a context."""
    rows = []
    for nxt, n in cands.get(ctx, {}).items():
        logit = math.log(n)
        pen = nxt in seen and logit != 0
        rows.append((-round(logit / penalty if pen else logit, 9), pen, nxt, logit / penalty if pen else logit))
    if not rows:
        return 1
    rows.sort()
    if t == 0:
        return rows[0][2]
    e = [math.exp((r[3] - max(x[3] for x in rows)) / t) for r in rows]
    z, kept, before = sum(e), [], 0.0
    for r, m in zip(rows, e):
        if before <= (top_p + 1e-9) * z or top_p >= 1:
            kept.append((r[2], m))
        before += m
    x, run = _u(f"{pid}|{step}") * (sum(m for _, m in kept) + 1e-8 * z), 0.0
    for nxt, m in kept:
        run += m
        if run > x:
            return nxt
    return kept[-1][0]


@pytest.mark.parametrize("top_p, t, context", [(0.9, 0.8, None), (1.0, 0.7, 3), (1.0, 0, None)])
def test_sampled_generation_with_a_hot_context(spark, top_p, t, context):
    rng = random.Random(4)
    cands = {c: {n: rng.choice([1, 1, 1, 2, 3, 8, 8, 20]) for n in rng.sample(range(1, 60), 8)} for c in range(1, 40)}
    cands[1] = {n: 1 + (n % 3) * (n % 5) for n in range(1, 400)}  # holds half of all pairs
    prompts = [(p, [rng.randint(1, 45) for _ in range(6)] + [rng.choice([1, 1, 2, 44])]) for p in range(25)]
    table = spark.createDataFrame([(c, n, k) for c, v in cands.items() for n, k in v.items()], "ctx int, nxt int, n long")
    past = [(p, x, max(i + 1 for i, y in enumerate(w) if y == x)) for p, w in prompts for x in set(w)]
    out = dc.generate(spark.createDataFrame([(p, w[-1], len(w)) for p, w in prompts], "pid long, ctx int, length int"), dc.candidates_from_counts(table), 2, "topp",
                      top_p=top_p, temperature=t, penalty=1.5, seed=42, past=spark.createDataFrame(past, "pid long, token int, pos int"), context=context)
    got = {(r["pid"], r["step"]): r["token"] for r in out.collect()}
    for p, words in prompts:
        words = list(words)
        for step in (1, 2):
            seen = set(words[-context:] if context else words)
            want = plain_step(p, step, words[-1], cands, seen, top_p, t, 1.5)
            assert got[(p, step)] == want, (p, step)
            words.append(want)


def test_no_window_holds_the_rows_of_a_context(spark):
    c = dc.candidates_from_counts(spark.createDataFrame([(1, n, 1 + n % 4) for n in range(300)] + [(2, 5, 1)], "ctx int, nxt int, n long"))
    for df in (dc.softmax(c), dc.cum_prob(c), dc.nucleus(c, 0.9, 0.8), dc.draw_from(dc.nucleus(c, 0.9, 0.8), 42)):
        df.collect()
        plan = df._jdf.queryExecution().toString()
        specs = re.findall(r"windowspecdefinition\(ctx#[^)]*\)", plan)
        assert all("_pid" in x for x in specs)  # over one count a partition, not over the context's rows
    assert abs(dc.cum_prob(c).where("ctx = 1").agg(F.max("cum")).first()[0] - 1) < 1e-9


def test_greedy_chains_are_followed_once_a_last_token_and_hot_ones_are_spread(spark):
    from corpuslab.operators.ranking import spread_join

    cands = dc.candidates_from_counts(spark.createDataFrame([(c, (c * 7 + j) % 30 + 1, 1 + (c + j) % 3) for c in range(1, 25) for j in range(4)], "ctx int, nxt int, n long"))
    prompts = spark.range(600).select(F.col("id").alias("pid"), F.when(F.col("id") % 3 > 0, 4).otherwise(F.col("id") % 29).cast("int").alias("ctx"))
    out = dc.generate(prompts, cands, 5, "greedy")
    got = {(r["pid"], r["step"]): r["token"] for r in out.collect()}
    best = {r["ctx"]: r["nxt"] for r in dc.greedy(cands).collect()}
    for r in prompts.collect():
        at = r["ctx"]
        for step in range(1, 6):
            at = best.get(at, 1)
            assert got[(r["pid"], step)] == at
    assert len(got) == 3000
    names = spark.createDataFrame([(i, f"n{i}") for i in range(29)], "ctx int, name string")
    joined = spread_join(prompts, names, "ctx", "pid", limit=10)
    assert sorted(joined.columns) == ["ctx", "name", "pid"] and {(r["pid"], r["name"]) for r in joined.collect()} == {(r["pid"], f"n{r['ctx']}") for r in prompts.collect()}
    assert joined.count() == 600


def test_rendering_broadcasts_no_vocabulary_and_frees_its_tokens(spark, monkeypatch):
    from corpuslab.operators import vectors as vx
    from corpuslab.plans import q_sources, views

    asked, sizes, real = [], [], q_sources.broadcast_if_small
    monkeypatch.setattr(q_sources, "broadcast_if_small", lambda df, *a, **k: sizes.append((df.columns, df.count())) or real(df, *a, **k))
    knn = vx.cosine_knn
    monkeypatch.setattr(vx, "cosine_knn", lambda q, *a, **k: asked.append(q.count()) or knn(q, *a, **k))
    sf = "/root/testdata/sf0.001"
    spark.catalog.clearCache()
    out = q_sources.render_annotated(spark, sf)
    tokens = views.vocab(spark, sf).count()
    assert sizes and all(n < tokens for _, n in sizes)  # only words that are asked for
    assert asked[0] < spark.read.parquet(f"{sf}/embeddings.parquet").count()  # only generated tokens have their neighbours searched
    assert out.count() == views.documents(spark, sf).count()
    spark.catalog.clearCache()

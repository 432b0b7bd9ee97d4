"""Packed prompts: hot contexts spread over slices, choices under a penalty, merged pairs."""

from __future__ import annotations

import contextlib
import io
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from corpuslab.operators import decode as dc
from corpuslab.operators import grams
from corpuslab.operators import prompts as pr


def _texts(n=60):
    rng = random.Random(9)
    return [[rng.choice([1, 1, 1, 2, 3, rng.randint(1, 40)]) for _ in range(rng.randint(2, 30))] + [rng.choice([1, 1, 2, 39])] for _ in range(n)]


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, ids array<int>").repartition(3)


def _prompts(docs):
    return docs.select(F.col("doc_id").alias("pid"), F.element_at("ids", -1).alias("ctx"), F.col("ids").alias("own"))


def _counts(texts):
    return Counter((a, b) for t in texts for a, b in zip(t, t[1:]))


def test_penalised_choice_equals_brute_force_and_explodes_nothing(spark):
    texts = _texts()
    docs, n = _docs(spark, texts), _counts(texts)
    out = dc.penalised_choice(_prompts(docs), pr.counted(docs), 1.5)
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        out.explain()
    assert "Generate" not in plan.getvalue()  # no row for each token of a document
    got = {r["pid"]: (r["n_cand"], r["n_penalized"], r["choice"], round(r["choice_logit"], 9)) for r in out.collect()}
    want = {}
    for i, t in enumerate(texts):
        after = {b: math.log(c) for (a, b), c in n.items() if a == t[-1]}
        pl = {b: x / 1.5 if b in t else x for b, x in after.items()}
        if after:
            best = min(pl, key=lambda b: (-pl[b], b))
            want[i] = (len(after), len(set(after) & set(t)), best, round(pl[best], 9))
    assert got == want


def test_spread_contexts_and_rows_as_candidates_generate_the_same(spark, monkeypatch):
    texts = _texts()
    docs, n = _docs(spark, texts), _counts(texts)
    key = lambda df: sorted((r["pid"], r["step"], r["token"]) for r in df.collect())
    run = lambda cands: key(dc.generate(_prompts(docs), cands, 3, "topp", top_p=0.9))
    whole = run(pr.counted(docs))
    rows = dc.candidates_from_counts(spark.createDataFrame([(a, b, c) for (a, b), c in n.items()], "ctx int, nxt int, n long"))
    assert run(rows) == whole and len(whole) == 3 * len(texts)
    monkeypatch.setattr(pr, "HEAVY", 800)
    hot, pieces = pr._heavy(pr.packed(_prompts(docs)))
    assert 1 in hot.tolist() and pieces.max() > 2
    assert run(pr.counted(docs)) == whole


def test_merged_pairs_come_once_a_slice(spark):
    texts = _texts()
    ids = _docs(spark, texts).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train"))
    dealt = grams.pairs(ids, 4)
    got = {(r["c1"], r["nxt"]): r["n"] for r in grams.counts(dealt, 1).collect()}
    assert got == _counts([t for i, t in enumerate(texts) if i % 5])
    assert dealt.where(~F.col("held")).agg(F.sum("n")).first()[0] == len(got)  # each pair once, whatever the tasks that saw it
    held = grams.held(grams.pairs(ids, 4, (None, 4), by_doc=True), 1, (None, 4))
    plain = grams.held(grams.deal(ids, 1, 4, (None, 4), by_doc=True), 1, (None, 4))
    assert Counter(tuple(r) for r in held.collect()) == Counter(tuple(r) for r in plain.collect())


def test_heavy_contexts_go_into_pieces_and_score_the_same(spark, monkeypatch):
    from corpuslab.plans import q_lm

    texts = [[1, 2, 3 + i % 7, 1, 2, 4, i % 5 + 1, 1, 2] * 2 for i in range(40)]
    ids = _docs(spark, texts).withColumn("split", F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train")).withColumn("lang", F.lit("x"))
    key = lambda df: sorted(tuple(r[c] for c in ("k", "block", "n", "C", "m")) for r in df.collect())
    for blocks in ((None,), (4, 6)):
        plain = [grams.held(grams.deal(ids, k, 5, blocks), k, blocks).groupBy("k", "block", "n", "C").agg(F.sum("m").alias("m")) for k in q_lm.SWEEP_K]
        want = sorted(x for p in plain for x in key(p))
        merge = lambda rows: sorted((*k, m) for k, m in sum((Counter({r[:4]: r[4]}) for r in rows), Counter()).items())
        one = grams.pairs(ids, 5, blocks)
        hot = grams.heavy(one, len(blocks), least=30)
        assert (1 << 32) | 2 in hot[0].tolist() and hot[1].max() > 1
        real = grams.heavy
        monkeypatch.setattr(grams, "heavy", lambda *a: real(*a, least=30))
        monkeypatch.setattr(grams, "slices_for", lambda ids: 5)
        assert merge(key(q_lm._sweep_rows(ids, blocks))) == want
        monkeypatch.undo()
        dealt = grams.deal(ids, 3, 5, blocks, by=2, hot=hot).collect()
        assert len({r["slice"] for r in dealt}) > 1

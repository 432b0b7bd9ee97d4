"""Pairs counted as packed grams: decoding candidates, bigram scores and PPMI."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from corpuslab.operators import grams
from corpuslab.operators import kgram as lm
from corpuslab.operators.ranking import exact_rank
from corpuslab.plans import q_decode, q_lm, views

TEXTS = [[3, 1, 2, 1, 2, 1], [1, 3, 1, 3], [2], [5, 5, 5], [1, 2, 4]]


def _pairs():
    return Counter((a, b) for x in TEXTS for a, b in zip(x, x[1:]))


def _ids(spark):
    return spark.createDataFrame([(i, "train", x) for i, x in enumerate(TEXTS)], "doc_id long, split string, ids array<int>")


def test_totals_give_counts_context_sums_and_the_smallest_argmax(spark):
    want, sums, best = _pairs(), Counter(), defaultdict(list)
    for (a, b), n in want.items():
        sums[a] += n
        best[a].append((-n, b))
    got = grams.totals(grams.deal(_ids(spark), 1, 2), 1).collect()
    assert {(r["c1"], r["nxt"]): (r["n"], r["C"], r["pred"]) for r in got} == {(a, b): (n, sums[a], min(best[a])[1]) for (a, b), n in want.items()}
    assert len(got) == len(want)


def test_ppmi_of_counted_ids_comes_out_as_tokens(spark):
    pairs = _pairs()
    pc = spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "a int, b int, n_ab long")
    voc = spark.createDataFrame([(f"w{i}", i) for i in range(1, 6)], "t string, token_id int")
    got = {(r["a"], r["b"]): r["ppmi"] for r in lm.ppmi_counts(pc, voc).collect()}
    total, left, right = sum(pairs.values()), Counter(), Counter()
    for (a, b), n in pairs.items():
        left[a] += n
        right[b] += n
    assert got == {(f"w{a}", f"w{b}"): pytest.approx(max(0.0, math.log(n * total / (left[a] * right[b])))) for (a, b), n in pairs.items()}


def _no_checkpoint(*args, **kwargs):
    raise AssertionError("rows are checkpointed uncompressed")


def test_ranks_and_candidates_are_written_as_columns(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", _no_checkpoint)
    got = exact_rank(spark.range(100).withColumn("g", F.col("id") % 3), [F.col("id").desc()], partition_by=("g",), name="r").collect()
    assert all(r["r"] == len([x for x in range(100) if x % 3 == r["g"] and x >= r["id"]]) for r in got) and len(got) == 100
    cands, docs = q_decode.corpus(spark, SF_SMALL)
    assert cands.agg(F.sum("n")).first()[0] == docs.agg(F.sum(F.size("ids") - 1)).first()[0]


def test_bigram_scores_read_no_token_pair_rows(spark, monkeypatch):
    """Every pair is scored from packed grams: token pairs are never exploded to rows of strings."""
    monkeypatch.setattr(q_lm.tx, "next_pairs_array", _no_checkpoint)
    e = q_lm.bigram_eval(spark, SF_SMALL, by_lang=True).collect()
    assert {r["lang"] for r in e} <= {r["lang"] for r in views.documents(spark, SF_SMALL).select("lang").distinct().collect()} and len(e) > 1

"""Packed k-grams, ids by a sent vocabulary, compact token cache, keyed scores of slices without a model."""

from __future__ import annotations

import contextlib
import io
from collections import Counter

from conftest import SF_SMALL
from pyspark.sql import functions as F

from corpuslab.operators import grams, scorer
from corpuslab.operators import text as tt
from corpuslab.plans import views


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


DOCS = [(1, "train", [1, 2, 3, 1, 2, 3, 4]), (2, "train", [1, 2, 1, 2]), (3, "val", [1, 2, 3, 9, 1]), (None, "val", [7, 1, 2, 1]), (5, "val", [3]), (6, "train", [])]


def _brute(k, block=None):
    for doc, split, ids in DOCS:
        for i in range(len(ids) - 1):
            if block and (i + 1) % block == 0:
                continue
            back = i % block if block else i
            yield doc, split, (*[ids[i - d] if d <= back else 0 for d in range(k - 1, -1, -1)], ids[i + 1])


def test_packed_grams_equal_brute_force(spark):
    ids = spark.createDataFrame(DOCS, "doc_id long, split string, ids array<int>").repartition(3)
    for k in (1, 2, 3):
        blocks = (None, 2, 4)
        dealt = grams.deal(ids, k, 7, blocks, by_doc=True)
        got = Counter()
        for r in grams.held(dealt, k, blocks).collect():
            key = tuple(r[f"c{j}"] for j in range(1, k + 1))
            got[r["block"], r["doc_id"], (*key, r["nxt"]), r["m"], r["n"], r["C"], r["pred"]] += 1
        want = Counter()
        for b in blocks:
            train = Counter(g for _, s, g in _brute(k, b) if s == "train")
            for (doc, g), m in Counter((d, g) for d, s, g in _brute(k, b) if s == "val").items():
                after = {x[-1]: n for x, n in train.items() if x[:-1] == g[:-1]}
                pred = min(after, key=lambda x: (-after[x], x)) if after else None
                want[b or 0, doc, g, m, train[g], sum(after.values()), pred] += 1
        assert got == want
        if k > 1:  # an order below, by the same exchange
            both = grams.held(grams.deal(ids, k, 7, blocks, by_doc=True, by=k - 1), k, blocks, (k, k - 1)).drop("c1").where(F.col("k") == k - 1)
            alone = grams.held(grams.deal(ids, k - 1, 7, blocks, by_doc=True), k - 1, blocks)
            drop = [tuple(r[x] for x in both.columns if x != "m") for r in both.collect()]
            assert set(drop) == {tuple(r) for r in alone.drop("m").collect()}
        one = grams.counts(grams.deal(ids, k, 7), k)
        assert Counter({tuple(r)[:-1]: r["n"] for r in one.collect()}) == Counter(g for _, s, g in _brute(k) if s == "train")
    assert grams.held(grams.deal(ids.where(F.lit(False)), 3, 2), 3).count() == 0


def test_held_out_look_up_exchanges_grams_once(spark):
    ids = spark.createDataFrame(DOCS, "doc_id long, split string, ids array<int>")
    assert _plan(grams.held(grams.deal(ids, 3, 4), 3)).count("Exchange") == 1


def test_encoding_exchanges_packed_dictionaries(spark):
    arr, voc = views.doc_tokens(spark, SF_SMALL), views.vocab(spark, SF_SMALL)
    one, many = tt.encode_arrays(arr, voc), tt.encode_arrays(arr, voc, block_tokens=5000)
    assert "Generate" not in _plan(one).split("InMemoryRelation")[0]  # no row for each token of a document
    ids = {r["t"]: r["token_id"] for r in voc.collect()}
    want = {r["doc_id"]: [ids[t] for t in r["toks"]] for r in arr.collect() if r["toks"]}
    for got in (one, many):
        assert {r["doc_id"]: r["ids"] for r in got.collect()} == want


def test_token_cache_keeps_one_string_a_document(spark):
    arr = views.doc_tokens(spark, SF_SMALL)
    assert "line#" in _plan(arr)
    got = {r["doc_id"]: r["toks"] for r in arr.collect()}
    for r in tt.token_arrays(views.documents(spark, SF_SMALL)).collect():
        assert got[r["doc_id"]] == r["toks"]


def test_keyed_scores_of_rows_and_model_from_one_table(spark):
    table = spark.createDataFrame([(i, f"{i}", i, 3, i % 2) for i in range(40)], "doc_id long, ctx string, nxt int, C long, n long")
    rows, model = table.drop("n"), table.where("n > 0").select("ctx", "nxt", "n").distinct()
    got = {r["doc_id"]: r["n"] for r in scorer.score_keyed(rows, model, ["ctx", "nxt"], scorer.CountScorer(10)).collect()}
    assert got == {i: i % 2 for i in range(40)}

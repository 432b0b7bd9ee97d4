"""Token arrays encoded in place: same ids as the join, whatever the blocks."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from corpuslab.operators import text as tt
from corpuslab.plans import views


def test_in_place_ids_equal_the_join(spark):
    arr, voc = views.doc_tokens(spark, SF_SMALL), views.vocab(spark, SF_SMALL)
    joined = {r["doc_id"]: r["ids"] for r in tt.id_arrays(tt.encode(views.tok(spark, SF_SMALL), voc)).collect()}
    for size in (200, 10**6):
        got = tt.encode_arrays(arr, voc, block_tokens=size).collect()
        assert len(got) == len(joined) and all(r["ids"] == joined[r["doc_id"]] for r in got)


def test_odd_token_arrays(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["zz"]), (5, ["b", "zz", "c"]), (None, ["c"])], "doc_id long, toks array<string>")
    voc = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "t string, token_id int")
    assert sorted(((r["doc_id"] or 0), r["ids"]) for r in tt.encode_arrays(docs, voc).collect()) == [(0, [3]), (1, [1, 2, 1]), (5, [2, 3])]
    assert tt.encode_arrays(docs.where(F.lit(False)), voc).count() == 0
    assert tt.encode_arrays(docs, voc.where(F.lit(False))).count() == 0


def test_arrays_are_decoded_in_place(spark):
    docs = spark.createDataFrame([(1, [1, 2, 1]), (2, []), (3, None), (4, [9]), (5, [2, 9, 3]), (None, [3])], "doc_id long, ids array<int>")
    voc = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "t string, token_id int")
    want = [(0, "c", 1), (1, "a b a", 3), (5, "b c", 2)]
    for size in (1, 2, 10**6):
        assert sorted(((r["doc_id"] or 0), r["text"], r["n_tokens"]) for r in tt.decode_arrays(docs, voc, block_tokens=size).collect()) == want
    assert tt.decode_arrays(docs, voc.where(F.lit(False))).count() == 0
    assert tt.decode_arrays(docs.where(F.lit(False)), voc).count() == 0


def test_round_trip_and_look_up_move_no_token_rows(spark, monkeypatch):
    from corpuslab.plans import q_text, q_vectors

    monkeypatch.setattr(tt, "broadcast_if_small", lambda df: df)  # as with a large vocabulary
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query in (q_text.decode_roundtrip, q_vectors.embed_lookup):
            plan = query(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
            assert not [x for x in plan.splitlines() if "hashpartitioning(t#" in x or "hashpartitioning(token_id#" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)

"""Empty, one-token and all-null inputs: operators return empty or NULL results, never fail."""

from pyspark.sql import functions as F

from corpuslab.operators import decode as dc
from corpuslab.operators import kgram as lm
from corpuslab.operators import runlog as rl
from corpuslab.operators import sampling as sm
from corpuslab.operators import stats as st
from corpuslab.operators import text as tt
from corpuslab.operators import vectors as vx


def test_empty_text_pipeline(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tok = tt.tokenize(docs)
    assert tok.count() == 0
    assert tt.build_vocab(tok.select("t")).count() == 0
    assert sm.split_exact(docs, 0.1, 42).count() == 0
    assert tt.next_pairs(tt.token_arrays(docs)).count() == 0


def test_one_token_documents(spark):
    docs = spark.createDataFrame([(1, "word"), (2, "x")], "doc_id long, text string")
    arr = tt.token_arrays(docs)
    assert tt.next_pairs(arr).count() == 0
    counts = lm.fit_counts(tt.next_pairs(arr).select(F.col("t").alias("ctx"), "nxt"))
    assert counts.count() == 0


def test_empty_and_null_statistics(spark):
    empty = spark.createDataFrame([], "g string, x double, y double")
    assert st.corr_matrix(empty, ["x", "y"]).count() == 0
    assert st.quantiles(empty, ["g"], "x").count() == 0
    assert st.skyline_2d(empty, "x", "y").count() == 0
    assert st.hull(empty, "x", "y").count() == 0
    nulls = spark.createDataFrame([("a", None, None), ("a", None, 1.0)], "g string, x double, y double")
    out = st.corr_matrix(nulls, ["x", "y"]).collect()
    assert out == [] or out[0]["corr"] is None


def test_empty_vectors_and_decoding(spark):
    emb = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vx.cosine_knn(emb, emb, 5).count() == 0
    cands = spark.createDataFrame([], "ctx int, nxt int, n long, logit double")
    assert dc.nucleus(cands, 0.9, 0.8).count() == 0
    assert dc.greedy(cands).count() == 0


def test_empty_runlog(spark):
    st_ = spark.createDataFrame([], "run long, epoch int, split string, step long, loss double")
    assert rl.partial_loss(st_, 3).count() == 0
    ev = spark.createDataFrame([], "user_id long, event_id long, t long")
    assert rl.interval_trigger(ev, "user_id", F.col("t"), 60).count() == 0

"""Stages on tables with clashing column names, repeated rows and null ids."""

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import decontam, langid, minhash, mixing, pii

CLASH = ["copy", "place", "_cdf", "_m0", "_s", "_rate", "_n", "_copy", "_place", "_base", "_spans", "_wide", "_found", "_lang_pred", "_score", "_n_words", "_hit_words", "_hit_items",
         "row key", "doc", "id", "n", "h1", "component_id", "kept", "user column 0", "z", "g", "v"]
TEXT = "please write to anna.smith@example.com or call +1 555 010 2233 about the quarterly numbers of the small northern office today"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT), (1, TEXT), (1, "a wholly different text stands under the same id here and it must stay in the result of the stage"), (None, "no id but text that repeats three times over in this table of rows"), (None, "no id but text that repeats three times over in this table of rows"),
            (2, TEXT + " indeed"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("web")})
    return df.withColumns({k: F.lit(f"user {k}") for k in CLASH})


def user_columns_unchanged(df, docs):
    assert [x for x in df.columns if x in docs.columns] == docs.columns
    for r in df.collect():
        assert all(r[k] == f"user {k}" for k in CLASH)


def test_near_dedup_keeps_one_row_of_repeated_rows(docs):
    out = minhash.keep_one(docs, percent=80)
    user_columns_unchanged(out, docs)
    got = sorted((r.doc_id or 0, (r.text or "")[:9]) for r in out.collect())
    assert got == [(0, "no id but"), (1, "a wholly "), (1, "please wr"), (3, ""), (4, "")]


def test_other_stages_pass_user_columns(spark, docs):
    clean = pii.redact(docs, None)
    user_columns_unchanged(clean, docs)
    assert not any("anna.smith" in str(v) or "555 010" in str(v) for r in clean.collect() for v in r)
    bench = spark.createDataFrame([("i1", "a wholly different text stands under the same id here and it must stay")], "item_id string, text string")
    left = decontam.drop_contaminated(docs, bench)
    user_columns_unchanged(left, docs)
    assert left.count() == docs.count() - 1
    mixed = mixing.replicate(docs, made=("copy", "place"), rows=40)
    user_columns_unchanged(mixed, docs)
    assert mixed.columns[-2:] == ["copy_1", "place_1"] and mixed.count() > 0


def test_language_stage_passes_user_columns(spark, docs):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    user_columns_unchanged(langid.reject_unknown(docs, model), docs)
    signs = spark.createDataFrame([(1, "²½ Ⅷ 12")], "doc_id long, text string")
    assert langid.identify(signs, model).first()["_lang_pred"] == "und"

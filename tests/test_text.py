from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators import text as tt


def test_kgram_windows_inclusive_and_exclusive(spark):
    df = spark.createDataFrame([(1, [7, 8, 9])], "doc_id long, ids array<int>")
    inc = sorted((r["pos"], list(r["ctx"])) for r in tt.kgrams(df, 3).collect())
    exc = sorted((r["pos"], list(r["ctx"])) for r in tt.kgrams(df, 3, include_current=False).collect())
    assert [c for _, c in inc] == [[0, 0, 7], [0, 7, 8], [7, 8, 9]]
    assert [c for _, c in exc] == [[0, 0, 0], [0, 0, 7], [0, 7, 8]]


def test_pad_batches(spark):
    df = spark.createDataFrame([(0, 1, [1, 2, 3]), (0, 2, [4])], "batch_id long, doc_id long, ids array<int>")
    out = {r["doc_id"]: list(r["padded"]) for r in tt.pad_batches(df).collect()}
    assert out == {1: [1, 2, 3], 2: [4, 0, 0]}
    w = tt.pad_waste(tt.pad_batches(df)).first()
    assert (w["cells"], w["pad_cells"]) == (6, 2)


def test_tokenize_whole_text_and_edges(spark):
    df = spark.createDataFrame([(1, "Hello, World! 123 Éa."), (2, ""), (3, "one")], "doc_id long, text string")
    toks = {}
    for r in tt.tokenize(df).collect():
        toks.setdefault(r["doc_id"], []).append((r["pos"], r["t"]))
    assert [t for _, t in sorted(toks[1])] == ["hello", ",", "world", "!", "123", "éa", "."]
    assert 2 not in toks and toks[3] == [(1, "one")]
    arr = tt.token_arrays(df)
    pairs = tt.next_pairs(arr).collect()
    assert {r["doc_id"] for r in pairs} == {1}  # one-token and empty texts give no pairs
    assert len(pairs) == 6


def test_line_scan_strips_and_drops_blank(spark):
    df = spark.createDataFrame([(1, "  a \n\n\t b\r\nc\u00a0 \r  ")], "doc_id long, text string")
    got = [(r["line_no"], r["line"]) for r in tt.line_scan(df).orderBy("line_no").collect()]
    assert got == [(1, "a"), (3, "b"), (4, "c")]


def test_blocks_keep_every_token(spark):
    df = spark.createDataFrame([(1, list(range(1, 11))), (2, [])], "doc_id long, ids array<int>")
    b = tt.blocks(df, 4).orderBy("doc_id", "block").collect()
    assert [list(r["seq"]) for r in b] == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10]]


def test_vocab_ids_by_count_then_token(spark):
    tok = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("a",), ("d",)], "t string")
    v = {r["t"]: r["token_id"] for r in tt.build_vocab(tok).collect()}
    assert v == {"a": 1, "b": 2, "c": 3, "d": 4}


def test_tail_and_truncate(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "a array<int>")
    r = df.select(tx.tail("a", 2).alias("t"), tx.truncate("a", 2).alias("h"), tx.tail("a", 9).alias("all")).first()
    assert list(r["t"]) == [4, 5] and list(r["h"]) == [1, 2] and list(r["all"]) == [1, 2, 3, 4, 5]


def test_pluggable_tokenizer_matches_jvm(spark):
    from conftest import SF_SMALL
    from corpuslab.plans import views

    docs = views.documents(spark, SF_SMALL)
    a = {r["doc_id"]: list(r["toks"]) for r in tt.token_arrays(docs).collect()}
    b = {r["doc_id"]: list(r["toks"]) for r in tt.tokenize_with(docs, tt.regex_tokenizer).collect()}
    assert a == b


def test_tokens_are_counted_without_a_row_a_token(spark):
    from pyspark.sql import functions as F

    from corpuslab.operators import text as tt

    lines = [("a b a",), ("",), (None,), ("b",), ("é a",)]
    df = spark.createDataFrame(lines, "line string").repartition(2)
    assert {(r["t"], r["c"]) for r in tt.count_tokens(df).collect()} == {("a", 3), ("b", 2), ("é", 1)}
    plain = df.select(F.explode(F.split("line", " ")).alias("t")).where("t <> ''")
    key = lambda v: sorted(tuple(r) for r in v.collect())
    assert key(tt.ranked_vocab(tt.count_tokens(df))) == key(tt.build_vocab(plain))
    assert tt.count_tokens(df.where("false")).count() == 0

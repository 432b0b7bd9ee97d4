"""Pairs of padded batches against padding written out."""

from collections import Counter

from corpuslab.operators import text as tt


def test_padded_pairs(spark):
    seqs = [(0, [5, 6, 5, 6, 5]), (0, [5]), (0, []), (1, [7, 7]), (1, [8, 7]), (2, []), (2, []), (3, [9]), (None, [1, 2]), (None, [])]
    got = {(r["ctx"], r["nxt"]): r["n"] for r in tt.padded_pairs(spark.createDataFrame(seqs, "batch_id int, ids array<int>").where("batch_id is not null")).collect()}
    want = Counter()
    for batch in range(4):
        rows = [ids for b, ids in seqs if b == batch]
        longest = max(map(len, rows))
        for ids in rows:
            line = ids + [0] * (longest - len(ids))
            want.update(zip(line, line[1:]))
    assert got == dict(want)
    assert tt.padded_pairs(spark.createDataFrame([], "batch_id int, ids array<int>")).count() == 0


def test_pairs_and_padding_exchange_no_arrays_and_no_pair_rows(spark):
    df = spark.createDataFrame([(0, [5, 6, 5]), (0, []), (1, [7, 0]), (None, [1]), (None, [1, 2])], "batch_id int, ids array<int>")
    plan = tt.pad_batches(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    got = sorted((str(r["batch_id"]), r["ids"], r["max_len"], r["padded"]) for r in tt.pad_batches(df).collect())
    assert got == [("0", [], 3, [0, 0, 0]), ("0", [5, 6, 5], 3, [5, 6, 5]), ("1", [7, 0], 2, [7, 0]), ("None", [1], 2, [1, 0]), ("None", [1, 2], 2, [1, 2])]
    pairs = tt.padded_pairs(df.where("batch_id is not null"))
    assert "Generate" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {(r["ctx"], r["nxt"]): r["n"] for r in pairs.collect()} == {(5, 6): 1, (6, 5): 1, (0, 0): 2, (7, 0): 1}

from pyspark.sql import functions as F

from corpuslab.operators import sampling as sm
from corpuslab.operators.ranking import exact_rank


def test_split_exact_count_and_disjoint(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    s = sm.split_exact(df, 0.1, 42, "doc_id")
    c = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"val": 100, "train": 900}


def test_exact_rank_matches_window_with_hot_group(spark):
    rows = [(0 if i % 3 else i, i) for i in range(3000)]  # group 0 holds two thirds of the rows
    df = spark.createDataFrame(rows, "g long, o long")
    got = {(r["g"], r["o"]): r["rank"] for r in exact_rank(df, ["o"], partition_by=("g",), name="rank").collect()}
    from pyspark.sql import Window

    want = {(r["g"], r["o"]): r["rank"] for r in df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("o"))).collect()}
    assert got == want


def test_mixture_shares_and_single_pool(spark):
    a = spark.range(100).withColumnRenamed("id", "item_id")
    b = spark.range(1000, 1010).withColumnRenamed("id", "item_id")
    m = sm.mix(a, b, 0.9, 7, "item_id")
    assert m.count() == 110 and m.where((F.col("source") == "b") & (F.col("item_id") < 1000)).count() == 0
    only = sm.mix(a, b.limit(0), 0.5, 7, "item_id")
    assert only.where(F.col("source") == "b").count() == 0 and only.count() == 100


def test_shuffle_is_a_permutation(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("epoch", F.lit(1))
    r = sm.shuffle_rank(df, 42, "epoch", "doc_id")
    assert sorted(x["rank"] for x in r.collect()) == list(range(1, 201))

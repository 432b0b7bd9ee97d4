"""Sampling, splitting, shuffling and batching with keyed hash draws (repeatable, no rand())."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.hashing import draw
from corpuslab.operators.ranking import broadcast_if_small, exact_rank


HIST_BUCKETS = 4096


def split_column(df: DataFrame, frac: float, seed, key: str = "doc_id"):
    """Exact-count random split as a column expression: the ``int(frac*n)`` rows with the
    smallest (u(seed,key), key) are 'val', the rest 'train'.

    The cut is found without ranking every row: a histogram of u over 4096 equal buckets
    (one aggregation, 4096 rows to the driver) locates the bucket holding the cut, and only
    that bucket (about n/4096 rows, uniform by construction of u) is ordered to read the cut
    row. The split is then a column predicate, applied to any DataFrame carrying ``key``
    without a join."""
    u = draw(seed, key)
    hist = df.select(F.floor(u * HIST_BUCKETS).cast("int").alias("b")).groupBy("b").count().collect()
    n = sum(r["count"] for r in hist)
    n_val = int(frac * n)
    if n_val <= 0:
        return F.lit("train")
    cum = 0
    target, need = None, None
    for r in sorted(hist, key=lambda r: r["b"]):
        if cum + r["count"] >= n_val:
            target, need = r["b"], n_val - cum
            break
        cum += r["count"]
    in_bucket = df.select(key, u.alias("_u")).where(F.floor(F.col("_u") * HIST_BUCKETS).cast("int") == target)
    cut = in_bucket.orderBy("_u", key).offset(need - 1).limit(1).first()
    is_val = (u < F.lit(cut["_u"])) | ((u == F.lit(cut["_u"])) & (F.col(key) <= F.lit(cut[key])))
    return F.when(is_val, F.lit("val")).otherwise(F.lit("train"))


def split_exact(df: DataFrame, frac: float, seed, key: str = "doc_id", flag: str = "split") -> DataFrame:
    """Exact-count random train/val split (see ``split_column``)."""
    return df.withColumn(flag, split_column(df, frac, seed, key))


def bounded_sample(df: DataFrame, n: int, seed, keys: list[str]) -> DataFrame:
    """At most ``n`` rows, those of smallest (u(seed, keys), keys): what a model is fitted on or a recall measured with.
    Results that must hold for all rows are never taken from it."""
    return df.withColumn("_u", draw(seed, *keys)).orderBy("_u", *keys).limit(n).drop("_u")


def shuffle_rank(df: DataFrame, seed, epoch_col: str, key: str, name: str = "rank") -> DataFrame:
    """Epoch shuffle: position of every row in the order of md5(seed|epoch|key), per epoch."""
    keyed = df.withColumn("_u", draw(seed, epoch_col, key))
    return exact_rank(keyed, ["_u", key], partition_by=(epoch_col,), name=name).drop("_u")


def batches(ranked: DataFrame, size: int, rank_col: str = "rank", name: str = "batch_id") -> DataFrame:
    """Fixed-size batches on a rank; the last short batch is kept."""
    return ranked.withColumn(name, F.floor((F.col(rank_col) - 1) / size).cast("bigint"))


def cap_steps(batched: DataFrame, max_steps: int, name: str = "batch_id") -> DataFrame:
    """Steps-per-epoch cap: keep the first ``max_steps`` batches."""
    return batched.where(F.col(name) < max_steps)


def dense_index(pool: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """0-based dense index of a pool by key."""
    return exact_rank(pool, [key], name=name).withColumn(name, F.col(name) - 1)


def mix(pool_a: DataFrame, pool_b: DataFrame, p: float, seed, key: str = "item_id", n: int | None = None) -> DataFrame:
    """Weighted two-source mixture with replacement: ``n`` draws (default |A|+|B|); source A with
    probability p, then a uniform row of that source. One empty pool -> always the other."""
    spark = pool_a.sparkSession
    na, nb = pool_a.count(), pool_b.count()
    if na + nb == 0:
        raise ValueError("both pools are empty")
    n = na + nb if n is None else n
    pa = 0.0 if na == 0 else (1.0 if nb == 0 else p)
    draws = spark.range(n).withColumnRenamed("id", "draw_id")
    draws = draws.withColumn("source", F.when(draw(seed, F.lit("src"), "draw_id") < F.lit(pa), F.lit("a")).otherwise(F.lit("b")))
    draws = draws.withColumn(
        "idx",
        F.floor(draw(seed, F.lit("idx"), "draw_id") * F.when(F.col("source") == "a", F.lit(na)).otherwise(F.lit(nb))).cast("bigint"),
    )
    ia = dense_index(pool_a.select(key), key).withColumn("source", F.lit("a"))
    ib = dense_index(pool_b.select(key), key).withColumn("source", F.lit("b"))
    pools = ia.unionByName(ib)
    return draws.join(broadcast_if_small(pools), ["source", "idx"], "inner").select(
        "draw_id", "source", "idx", key
    )


def sample_top(df: DataFrame, seed, key: str, n: int) -> DataFrame:
    """Random search without replacement: the n rows with the smallest hash draw (a sampling
    operator: the limit is the feature; planned as TakeOrderedAndProject)."""
    return df.withColumn("_u", draw(seed, key)).orderBy("_u", key).limit(n).drop("_u")

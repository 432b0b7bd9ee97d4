"""Bucketed cosine neighbours: signed random projections, several probes per table, exact rescoring.

A vector's code in a table is the signs of its projections on ``bits`` random directions. Every row of
the searched side sits in one bucket of each table; a query looks into ``probes`` buckets of each table,
the ones that flip the projections closest to zero first. Rows of a common bucket are compared exactly, so
a neighbour can be missed but never misjudged. ``bits`` follows from the number of rows (buckets of about
``BUCKET`` rows); ``probes`` is raised until the recall measured against the exact search on ``AUDIT``
queries reaches the target. Once the probes compare or exchange more than the exact search, no bit is left and the
search is exact (pieces of the queries against pieces of the table), so the target is always reached. The measured recall
is a column of the result.

A vector travels tables (or tables x probes) times whatever the number of rows, never once per opposite
block. A bucket of more than a block's rows, as near copies make it, is compared in pieces of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.operators.ranking import broadcast_if_small
from corpuslab.operators.sampling import bounded_sample
from corpuslab.operators.vectors import QUERY_BLOCK, SLICE, TABLE_BLOCK, _best, as_double, cosine_knn
from corpuslab.session import ensure_checkpoint_dir

TABLES = 4  # independent sets of directions
BUCKET = 512  # rows a bucket should hold on average
FLIPS = 12  # projections of a row that a probe may flip: 4,096 probes at most
AUDIT = 1000  # queries whose exact neighbours measure the recall
COPIES = 64  # copies of a vector that probing may exchange before the exact search, where that exchanges fewer


@dataclass(frozen=True)
class Plan:
    bits: int
    probes: int
    tables: int = TABLES
    seed: int = 7

    def wider(self) -> Plan:
        """Twice the probes; once all are spent, half the buckets."""
        if self.probes < 1 << min(self.bits, FLIPS):
            return Plan(self.bits, self.probes * 2, self.tables, self.seed)
        return Plan(self.bits - 1, 1 << min(self.bits - 1, FLIPS), self.tables, self.seed)

    @property
    def copies(self) -> int:
        """Times that a vector is exchanged as a query and as a row of the table."""
        return self.tables * (self.probes + 1) if self.bits else 2

    @property
    def spent(self) -> bool:
        """Whether tables x probes compare as many pairs as the exact search."""
        return self.tables * self.probes >= 1 << self.bits

    @property
    def whole(self) -> bool:
        return self.bits == 0


def start_plan(rows: int, bucket: int = BUCKET) -> Plan:
    bits = max(0, min(40, math.ceil(math.log2(max(1, rows) / bucket))))
    return Plan(bits, min(4, 1 << bits))


def probed(margins: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes) codes: a row's own first, then those that flip the least margin in sum."""
    rows, bits = margins.shape
    own = (margins > 0).astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64)) if bits else np.zeros(rows, np.int64)
    if probes <= 1 or not bits:
        return own[:, None]
    free = min(bits, FLIPS)
    low = np.argsort(np.abs(margins), axis=1)[:, :free]
    subsets = (np.arange(1 << free)[:, None] >> np.arange(free)) & 1
    cost = np.take_along_axis(np.abs(margins), low, 1) @ subsets.T
    best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    weight = np.int64(1) << low.astype(np.int64)
    flip = np.stack([(subsets[b] * weight[i]).sum(axis=1) for i, b in enumerate(best)])
    return own[:, None] ^ flip


def buckets(vec: str, dim: int, plan: Plan, probes: int) -> Column:
    """Array of bucket numbers, table in the upper bits."""
    planes = np.random.default_rng(plan.seed).normal(size=(plan.tables, plan.bits, dim))

    def code(vectors: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(vectors), 256):
            x = np.stack(vectors.iloc[at : at + 256].to_numpy()).astype(np.float64)
            per_table = [probed(x @ planes[t].T, probes) | (np.int64(t) << 48) for t in range(plan.tables if plan.bits else 1)]
            out.extend(np.concatenate(per_table, axis=1))
        return pd.Series(out)

    return F.pandas_udf(code, "array<long>")(F.col(vec))


def _usable(df: DataFrame, id_col: str, vec_col: str, key: str, vec: str) -> DataFrame:
    """Rows whose vector is there, finite and not zero."""
    real = isinstance(df.schema[vec_col].dataType.elementType, (T.FloatType, T.DoubleType))  # exchanged as they are
    v = df.select(F.col(id_col).alias(key), (F.col(vec_col) if real else as_double(vec_col)).alias(vec)).where(F.col(key).isNotNull() & F.col(vec).isNotNull())
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where((F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0))


def _candidates(q: DataFrame, t: DataFrame, dim: int, plan: Plan, keep: int, block: int, table_block: int) -> DataFrame:
    """(qid, nbr_id, sim): of every pair of a probed bucket's pieces, each query's best rows."""
    qb = q.withColumn("bucket", F.explode(buckets("qv", dim, plan, plan.probes)))
    tb = t.withColumn("bucket", F.explode(buckets("tv", dim, plan, 1)))

    def large(df: DataFrame, limit: int, name: str) -> DataFrame:
        counts = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > limit)
        return counts.select("bucket", F.ceil(F.col("c") / limit).cast("int").alias(name)).checkpoint(eager=True)

    nq, nt = large(qb, block, "nq"), large(tb, table_block, "nt")

    def pieces(df: DataFrame, key: str, mine: str, n_mine: str, other: str, n_other: str) -> DataFrame:
        x = df.join(broadcast_if_small(nq), "bucket", "left").join(broadcast_if_small(nt), "bucket", "left")
        x = x.withColumn(mine, F.pmod(F.xxhash64(key), F.coalesce(n_mine, F.lit(1))).cast("int"))
        x = x.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(n_other, F.lit(1)) - 1)))
        return x.drop("nq", "nt")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": [], "nbr_id": [], "sim": []})]
        if len(left) and len(right):
            right = right.sort_values("nbr_id", kind="stable")
            a, b = (np.stack(x.to_numpy()).astype(np.float64) for x in (left["qv"], right["tv"]))
            a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
            qid, ids = left["qid"].to_numpy(), right["nbr_id"].to_numpy()
            for low in range(0, len(a), QUERY_BLOCK):
                part, best, of = a[low : low + QUERY_BLOCK], np.zeros((min(QUERY_BLOCK, len(a) - low), 0)), None
                for at in range(0, len(b), SLICE):  # a query hands on its best rows of the whole piece
                    sims = part @ b[at : at + SLICE].T
                    row, col = _best(sims, keep)
                    made, new = sims[row, col].reshape(len(part), -1), ids[at + col].reshape(len(part), -1)
                    best, of = (made, new) if of is None else (np.hstack([best, made]), np.hstack([of, new]))
                    order = np.lexsort((of, -best), axis=1)[:, :keep]
                    best, of = np.take_along_axis(best, order, 1), np.take_along_axis(of, order, 1)
                out.append(pd.DataFrame({"qid": np.repeat(qid[low : low + QUERY_BLOCK], best.shape[1]), "nbr_id": of.reshape(-1), "sim": best.reshape(-1)}))
        return pd.concat(out) if len(out) > 1 else out[0]

    left = pieces(qb, "qid", "qp", "nq", "tp", "nt").groupBy("bucket", "qp", "tp")
    right = pieces(tb, "nbr_id", "tp", "nt", "qp", "nq").groupBy("bucket", "qp", "tp")
    found = left.cogroup(right).applyInPandas(search, "qid long, nbr_id long, sim double")
    return found.groupBy("qid", "nbr_id").agg(F.max("sim").alias("sim"))  # met in several tables or probes


def _ranked(found: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("sim").desc(), "nbr_id")  # group: a query's rows of its tables x probes
    ranked = found.where(F.col("qid") != F.col("nbr_id")).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= n).select("qid", "rank", "nbr_id", "sim")


def cosine_knn_lsh(queries: DataFrame, table: DataFrame, n: int = 5, target: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding",
                   bucket: int = BUCKET, block: int = TABLE_BLOCK, table_block: int = TABLE_BLOCK) -> DataFrame:
    """Cosine top-n neighbours of every query (its own id left out) among the table's rows, by probed buckets:
    (qid, rank, nbr_id, sim, recall). ``recall`` is one value, the share of the exact neighbours of ``AUDIT``
    queries (``bounded_sample`` by a hash of the id) that were found by the plan used for all of them, at least
    ``target``. Ids are unique in each table. Null, zero or non-finite vectors and those whose length is not
    the table's largest have no neighbours; an empty side gives no rows."""
    ensure_checkpoint_dir(queries.sparkSession)
    q, t = _usable(queries, id_col, vec_col, "qid", "qv"), _usable(table, id_col, vec_col, "nbr_id", "tv")
    dim = t.agg(F.max(F.size("tv"))).first()[0] or 0
    q, t = q.where(F.size("qv") == dim), t.where(F.size("tv") == dim)
    rows = t.count()
    plan = start_plan(rows, bucket)
    audit = bounded_sample(q, AUDIT, plan.seed, ["qid"]).checkpoint(eager=True)
    exact = cosine_knn(audit.select(F.col("qid").alias("id"), F.col("qv").alias("v")), t.select(F.col("nbr_id").alias("id"), F.col("tv").alias("v")),
                       n, id_col="id", vec_col="v", block=min(block, QUERY_BLOCK), table_block=table_block).select("qid", "nbr_id")
    # a neighbour is found where the query probes its bucket, so plans are tried on the owed pairs alone
    pairs = exact.join(F.broadcast(audit), "qid").join(t, "nbr_id").select("qid", "nbr_id", "qv", "tv").checkpoint(eager=True)
    owed, pieces = pairs.count(), -(-q.count() // block) + -(-rows // table_block)
    while True:
        hits = pairs.where(F.arrays_overlap(buckets("qv", dim, plan, plan.probes), buckets("tv", dim, plan, 1))).count()
        recall = hits / owed if owed else 1.0
        if recall >= target or plan.whole:
            break
        plan = plan.wider()
        if plan.spent or plan.copies > max(COPIES, pieces):
            plan = Plan(0, 1, plan.tables, plan.seed)
    return _ranked(_candidates(q, t, dim, plan, n + 1, block, table_block), n).withColumn("recall", F.lit(recall))

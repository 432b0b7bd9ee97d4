"""Vectors held as ARRAY<FLOAT|DOUBLE> columns: normalisation, pooling, drift, norms and exact
cosine top-n neighbours.

Element-wise work uses SQL higher-order functions (``transform``/``aggregate``/``zip_with``) so
it stays in the JVM. Pooling explodes (id, dim, value) and aggregates by (group, dim): partial
aggregation absorbs a hot group. Neighbour search scores bounded blocks of queries against bounded
blocks of the table with numpy and keeps only the local top-n per query, so no all-pairs rows are
ever materialised.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.operators.grams import _planes, _values
from corpuslab.operators.ranking import broadcast_if_small
from corpuslab.session import written

QUERY_BLOCK, TABLE_BLOCK = 2048, 32768  # rows of a query block and of a table block
BLOCK_BYTES = 8 << 20  # of the vectors of a packed block
QUERY_ROWS, SLICE = 1024, 4096  # queries and table rows that are scored at once


def as_double(vec) -> Column:
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.transform(v, lambda x: x.cast("double"))


def sum_sq(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(vec, eps: float = 1e-12) -> Column:
    v = as_double(vec)
    norm = F.greatest(F.sqrt(sum_sq(v)), F.lit(eps))
    return F.transform(v, lambda x: x / norm)


def rms_normalize(vec, eps: float = 1e-5) -> Column:
    v = as_double(vec)
    rms = F.sqrt(sum_sq(v) / F.size(v) + F.lit(eps))
    return F.transform(v, lambda x: x / rms)


def to_long(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """(keys, dim from 1, value)."""
    return df.select(*keys, F.posexplode(vec).alias("d0", "value")).select(*keys, (F.col("d0") + 1).alias("dim"), F.col("value").cast("double").alias("value"))


def pool_mean(df: DataFrame, by: str, vec: str) -> DataFrame:
    return to_long(df, [by], vec).groupBy(by, "dim").agg(F.avg("value").alias("value"))


def pool_weighted(df: DataFrame, by: str, vec: str, score: Column) -> DataFrame:
    """Softmax(score)-weighted sum per group and dimension. Group max and normaliser come from
    a grouped aggregation (one row per group) joined back, not a window over the group."""
    s = df.withColumn("_s", score)
    stats = s.groupBy(by).agg(F.max("_s").alias("_m"))
    s = s.join(broadcast_if_small(stats), by).withColumn("_e", F.exp(F.col("_s") - F.col("_m")))
    z = s.groupBy(by).agg(F.sum("_e").alias("_z"))
    w = s.join(broadcast_if_small(z), by).withColumn("_w", F.col("_e") / F.col("_z"))
    long = w.select(by, "_w", F.posexplode(vec).alias("d0", "x"))
    return long.groupBy(by, (F.col("d0") + 1).alias("dim")).agg(F.sum(F.col("_w") * F.col("x").cast("double")).alias("value"))


def pool_attention(df: DataFrame, by: str, vec: str) -> DataFrame:
    """Query-attention pooling: the group's mean vector is the query; weights are
    softmax(q . k / sqrt(d)) over the group; result is the weighted sum of the vectors."""
    means = pool_mean(df, by, vec)
    q = means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("_q"))
    j = df.join(broadcast_if_small(q), by)
    score = dot(as_double(vec), F.col("_q")) / F.sqrt(F.size(vec).cast("double"))
    return pool_weighted(j.withColumn("_score", score).drop("_q"), by, vec, F.col("_score"))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(sum_sq(a)) * F.sqrt(sum_sq(b)))


def _best(sims: np.ndarray, keep: int):
    """(query row, column) of the ``keep`` best similarities of each row; columns come in
    ascending order of ids, so that of equal similarities the smallest ids stay."""
    k = min(keep, sims.shape[1])
    if k == sims.shape[1]:
        part = np.tile(np.arange(k), (len(sims), 1))
    else:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        last = np.take_along_axis(sims, part, 1).min(axis=1, keepdims=True)
        for i in np.flatnonzero((sims >= last).sum(axis=1) > k):  # a tie at the boundary
            above, equal = np.flatnonzero(sims[i] > last[i]), np.flatnonzero(sims[i] == last[i])
            part[i] = np.concatenate([above, equal[: k - len(above)]])
    return np.repeat(np.arange(len(sims)), k), part.reshape(-1)


def _blocks_of(df: DataFrame, id_col: str, vec_col: str, block: int) -> DataFrame:
    """(block, ids, vecs): rows with a vector packed into blocks of at most ``block`` rows and ``BLOCK_BYTES`` bytes, written
    once to the shared folder. Floats stay as they are, other numbers become doubles."""
    real = isinstance(df.schema[vec_col].dataType.elementType, T.FloatType)
    kind, rows = (np.float32 if real else np.float64), df.where(F.col(vec_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), (F.col(vec_col) if real else as_double(vec_col)).alias("vec"))

    def pack(batches):
        held, n, made, size = [], 0, 0, block

        def flush():
            lens = np.unique(np.concatenate([x.column("vec").value_lengths().to_numpy(zero_copy_only=False) for x in held]))
            if len(lens) > 1:
                raise ValueError(f"vectors of different lengths: {lens.tolist()}")
            ids = np.concatenate([x.column("id").to_numpy(zero_copy_only=False) for x in held]).astype(np.int64)
            vecs = np.concatenate([x.column("vec").flatten().to_numpy(zero_copy_only=False) for x in held]).astype(kind)
            number = pa.array([TaskContext.get().partitionId() * (1 << 32) + made], pa.int64())
            return pa.RecordBatch.from_arrays([number, pa.array([ids.tobytes()], pa.binary()), pa.array([vecs.tobytes()], pa.binary())], ["block", "ids", "vecs"])

        for batch in batches:
            start = 0
            while start < batch.num_rows:
                if not held:
                    width = max(1, len(batch.column("vec")[start])) * np.dtype(kind).itemsize
                    size = min(block, max(1, BLOCK_BYTES // width))
                part = batch.slice(start, size - n)
                held.append(part)
                n, start = n + part.num_rows, start + part.num_rows
                if n >= size:
                    yield flush()
                    held, n, made = [], 0, made + 1
        if held:
            yield flush()

    return written(rows.mapInArrow(pack, "block long, ids binary, vecs binary"))


def _unit(ids: bytes, vecs: bytes, kind):
    """Ids in ascending order and their vectors divided by their norm."""
    ids = np.frombuffer(ids, np.int64)
    x = np.frombuffer(vecs, kind).reshape(len(ids), -1).astype(np.float64)
    order = np.argsort(ids, kind="stable")
    x = x[order]
    return ids[order], x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _leading(row: np.ndarray, sim: np.ndarray, nbr: np.ndarray, keep: int):
    """The ``keep`` best hits of each row, best first (ties: smaller id)."""
    order = np.lexsort((nbr, -sim, row))
    row, sim, nbr = row[order], sim[order], nbr[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    there = place < keep
    return row[there], sim[there], nbr[there], place[there]


def _meet(qid, a, ids, b, best, keep: int, drop_self: bool):
    """``best`` (rows of a, sims, ids) brought up to date with the table rows b."""
    out = [x for x in best]
    for low in range(0, len(a), QUERY_ROWS):
        part, own = a[low : low + QUERY_ROWS], qid[low : low + QUERY_ROWS]
        mine = (out[0] >= low) & (out[0] < low + len(part))
        row, sim, nbr = out[0][mine] - low, out[1][mine], out[2][mine]
        out = [x[~mine] for x in out]
        for at in range(0, len(b), SLICE):
            sims, names = part @ b[at : at + SLICE].T, ids[at : at + SLICE]
            if drop_self:
                first, last = np.searchsorted(names, own, "left"), np.searchsorted(names, own, "right")
                for i in np.flatnonzero(last > first):
                    sims[i, first[i] : last[i]] = -np.inf
            least = np.full(len(part), -np.inf)
            full = np.flatnonzero(np.bincount(row, minlength=len(part)) >= keep)
            if len(full):  # the worst hit that a row keeps
                worst = np.full(len(part), np.inf)
                np.minimum.at(worst, row, sim)
                least[full] = worst[full]
            if len(full) < len(part) and sims.shape[1] > keep:
                width = min(sims.shape[1], 64 * keep)
                least = np.maximum(least, np.partition(sims[:, :width], width - keep, axis=1)[:, width - keep])
            r, c = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
            row, sim, nbr, _ = _leading(np.r_[row, r], np.r_[sim, sims[r, c]], np.r_[nbr, names[c]], keep)
        out = [np.r_[out[0], row + low], np.r_[out[1], sim], np.r_[out[2], nbr]]
    return out


def cosine_knn(queries: DataFrame, table: DataFrame, n: int = 5, drop: str = "self", id_col: str = "vec_id",
               vec_col: str = "embedding", block: int = TABLE_BLOCK, table_block: int = TABLE_BLOCK) -> DataFrame:
    """Exact cosine top-n neighbours of every query row among the table rows: (qid, rank,
    nbr_id, sim). ``drop='self'`` removes the query's own id; ``drop='first'`` removes the
    best hit whatever it is (the reference's n+1-then-skip-first rule). Queries and table are packed into
    blocks and written once; each pair of a partition of query blocks and one of table blocks is a task that reads both from
    the shared folder (a cartesian product: no vector is exchanged) and hands on a query's best rows of the whole
    table partition, packed by a hash of the query's id. Nothing passes through the driver."""
    spark = queries.sparkSession
    keep, own = (n if drop == "self" else n + 1), drop == "self"
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = _blocks_of(queries, id_col, vec_col, block)
    same = queries is table and block == table_block
    t = q if same else _blocks_of(table, id_col, vec_col, table_block)
    q_kind, t_kind = (np.float32 if isinstance(x.schema[vec_col].dataType.elementType, T.FloatType) else np.float64 for x in (queries, table))

    def search(batches):
        at, qid, a, best = None, None, None, None

        def flush():
            row, sim, nbr = best
            ids = qid[row]
            part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(slices)
            order = np.argsort(part, kind="stable")
            start = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0]) if len(order) else np.zeros(0, np.int64)
            pieces = np.split(order, start[1:]) if len(order) else []
            cols = [pa.array(part[order][start].astype(np.int32), pa.int32()), pa.array([len(x) for x in pieces], pa.int32())]
            cols += [pa.array([_planes(v[x]) for x in pieces], pa.binary()) for v in (ids, nbr, sim)]
            return pa.RecordBatch.from_arrays(cols, ["slice", "n", "q", "nbr", "sim"])

        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("block")[i].as_py()
                if number != at:
                    if at is not None:
                        yield flush()
                    at, (qid, a) = number, _unit(batch.column("ids")[i].as_py(), batch.column("vecs")[i].as_py(), q_kind)
                    best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
                names, b = _unit(batch.column("t_ids")[i].as_py(), batch.column("t_vecs")[i].as_py(), t_kind)
                best = _meet(qid, a, names, b, best, keep, own)
        if at is not None:
            yield flush()

    def rank(key, pdf: pd.DataFrame) -> pd.DataFrame:
        size = [*pdf["n"]]
        qid, nbr, sim = (_values(pdf[c], size, kind) for c, kind in (("q", np.int64), ("nbr", np.int64), ("sim", np.float64)))
        qid, sim, nbr, place = _leading(qid, sim, nbr, keep)
        first = 0 if own else 1
        there = place >= first
        return pd.DataFrame({"qid": qid[there], "rank": (place[there] + 1 - first).astype(np.int32), "nbr_id": nbr[there], "sim": sim[there]})

    pairs = q.crossJoin(t.select(F.col("ids").alias("t_ids"), F.col("vecs").alias("t_vecs")).hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(search, "slice int, n int, q binary, nbr binary, sim binary")
    return found.groupBy("slice").applyInPandas(rank, "qid long, rank int, nbr_id long, sim double")


def cosine_drift(a: DataFrame, b: DataFrame, key: str, vec_a: str, vec_b: str, by: str | None = None) -> DataFrame:
    """Mean cosine between two versions of the same vectors, matched on key."""
    j = a.select(key, *( [by] if by else []), as_double(vec_a).alias("_a")).join(b.select(key, as_double(vec_b).alias("_b")), key)
    g = j.groupBy(by) if by else j.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(cosine(F.col("_a"), F.col("_b"))).alias("drift_cosine"))

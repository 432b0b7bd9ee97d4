"""Embedding whitening with distributed block matrices (Spark MLlib ``BlockMatrix``).

1. Vectors become whole numbers x = floor(256 c); the fit list is each distinct x once. Its rows are numbered
   without gaps (counts per partition give the offsets), centred and laid into blocks.
2. The scatter matrix is transpose times matrix. The block product is told to split the inner dimension
   over as many tasks as there are row blocks of work: only partial d x d sums meet, never the rows.
3. The driver holds one d x d matrix and gets its eigenvectors (``eigh``). The d x k whitening matrix is
   one block, and a block product projects all rows; the fit list's projection, multiplied with its own
   transpose, measures what is left between the whitened covariance and the identity.

Defined results: rows whose vector is null or holds null or non-finite entries are left out. Vectors shorter
than the longest are read as padded by zeros. Components without variance (eigenvalue below d times the
rounding of the largest) have no whitening and no rows; so an empty table, one distinct vector or vectors of
no entries give no row. Entries beyond a long's range saturate; a deviation beyond it is null. Repeated
rows and ids each keep their own rows, a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common as c

SCALE = 256  # whole steps of an entry
COMPONENTS = 4
BLOCK_ROWS, BLOCKS, BLOCK_BYTES = 256, 4096, 32 << 20  # least rows of a block; blocks until blocks grow; most bytes of one

_GOOD = "coalesce(forall(v, e -> e is not null and not isnan(e) and abs(e) < double('infinity')), false)"


def numbered(df: DataFrame, name: str = "i") -> DataFrame:
    """Rows with numbers 0, 1, 2, ... in the order of a checkpointed copy: no sort, no exchange of rows."""
    x = c.checkpointed(df).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    counts = x.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("m")).orderBy("_p").collect()  # one row a partition
    total, starts = 0, []
    for r in counts:
        starts.append((r["_p"], total - r["m"]))
        total += r["n"]
    if not starts:
        return x.withColumn(name, F.lit(0).cast("long")).drop("_p", "_m")
    shift = F.broadcast(df.sparkSession.createDataFrame(starts, "_p int, _s long"))
    return x.join(shift, "_p").withColumn(name, F.col("_m") + F.col("_s")).drop("_p", "_m", "_s")


def block_rows(n: int, dim: int) -> int:
    """Rows of a block: MLlib's driver keeps the number of every block, so blocks grow with the rows up to BLOCK_BYTES."""
    return max(1, min(max(BLOCK_ROWS, n // BLOCKS), BLOCK_BYTES // (8 * dim)))


def scaled(embeddings: DataFrame, id_col="vec_id", vector_col="embedding") -> tuple[DataFrame, int]:
    """id and x, the whole-number vector, of every usable row, and the dimension."""
    raw = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(_GOOD)
    dim = raw.agg(F.max(F.size("v"))).first()[0] or 0
    whole = F.transform("v", lambda e: F.floor(e * SCALE).cast("long"))
    return raw.select("id", F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("x")), dim


def _blocks(rows: DataFrame, n: int, mean: np.ndarray) -> BlockMatrix:
    """Centred rows (i, x) as a block matrix of ``block_rows`` rows a block."""
    d = len(mean)
    size = block_rows(n, d)
    centre = F.array(*[F.lit(float(m)) for m in mean])
    centred = F.zip_with("x", centre, lambda a, m: a.cast("double") - m)
    held = rows.select((F.col("i") / size).cast("int").alias("b"), F.struct("i", centred.alias("v")).alias("r")).groupBy("b").agg(F.sort_array(F.collect_list("r")).alias("r"))
    values = held.select("b", F.flatten(F.transform("r", lambda r: r["v"])).alias("values"))
    blocks = values.rdd.map(lambda r: ((r["b"], 0), DenseMatrix(len(r["values"]) // d, d, r["values"], True)))
    return BlockMatrix(blocks, size, d, n, d)


def _scatter(blocks: BlockMatrix, tasks: int) -> np.ndarray:
    """Transpose times matrix. The Python ``multiply`` would bring all row blocks to the one task of the one
    block of the result; the Scala one takes into how many tasks to split the inner dimension."""
    splits = max(1, min(blocks.numRowBlocks, tasks))
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def _project(spark, blocks: BlockMatrix, matrix: np.ndarray) -> BlockMatrix:
    """Rows times a d x k matrix of one block."""
    d, k = matrix.shape
    one = spark.sparkContext.parallelize([((0, 0), Matrices.dense(d, k, matrix.T.ravel().tolist()))], 1)
    return blocks.multiply(BlockMatrix(one, d, k, d, k))


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS):
    """n, sums per dimension, whitening matrix (dim x k), share of variance of each component and the
    largest entry of the whitened covariance minus the identity; None without variance."""
    distinct = numbered(rows.select("x").distinct())
    sums = {r["pos"]: (r["s"], r["n"]) for r in distinct.select(F.posexplode("x").alias("pos", "e")).groupBy("pos").agg(F.sum(F.col("e").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()}
    if not sums:
        return None
    n, total = sums[0][1], [int(sums[k][0]) for k in range(dim)]
    tasks = distinct.rdd.getNumPartitions()
    blocks = _blocks(distinct, n, np.array([s / n for s in total])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cov = _scatter(blocks, tasks) / n
        e, vectors = np.linalg.eigh((cov + cov.T) / 2)
        e, vectors = e[::-1], vectors[:, ::-1]
        kept = int((e[:components] > dim * np.finfo(float).eps * max(e[0], 0)).sum()) if e[0] > 0 else 0
        if not kept:
            return None
        white = vectors[:, :kept] / np.sqrt(e[:kept])
        identity = _scatter(_project(rows.sparkSession, blocks, white), tasks) / n - np.eye(kept)
        return n, total, white, e[:kept] / np.trace(cov), float(np.abs(identity).max())
    finally:
        blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)


def whiten(embeddings: DataFrame, id_col="vec_id", vector_col="embedding", components: int = COMPONENTS) -> DataFrame:
    """id, x, n, deviation, whitened (array, one entry a component), explained (array), identity_error."""
    spark = embeddings.sparkSession
    rows, dim = scaled(embeddings, id_col, vector_col)
    rows = c.checkpointed(rows)
    found = fit(rows, dim, components) if dim else None
    if found is None:
        return rows.where("false").select("id", "x", *[F.lit(None).cast(t).alias(k) for k, t in (("n", "long"), ("deviation", "long"), ("whitened", "array<double>"), ("explained", "array<double>"), ("identity_error", "double"))])
    n, total, white, share, error = found
    placed = numbered(rows)
    projected = _project(spark, _blocks(placed, placed.count(), np.array([s / n for s in total])), white).toIndexedRowMatrix()
    values = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model).select(F.col("index").alias("i"), vector_to_array("vector").alias("whitened"))
    sums = F.array(*[F.lit(s if abs(s) < 1 << 63 else None).cast("long") for s in total])
    gap = F.zip_with("x", sums, lambda a, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), a), s))
    deviation = F.aggregate(gap, F.lit(0).cast("long"), lambda acc, g: F.try_add(acc, F.try_multiply(g, g)))
    out = placed.withColumn("deviation", deviation).join(values, "i")
    return out.select("id", "x", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*[F.lit(float(s)) for s in share]).alias("explained"), F.lit(error).alias("identity_error"))


def query(spark, sf_dir: str) -> DataFrame:
    out = whiten(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
    each = out.select(F.col("id").alias("vec_id"), "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "z"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("z.whitened").alias("whitened"), F.col("z.explained").alias("explained"), "identity_error")

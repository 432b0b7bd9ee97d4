"""Embedding near-dedup by sorted projection passes.

Each pass hashes a vector by the signs of ``BITS`` random projections, concatenated to one number,
and orders all vectors lexicographically by it (an exact rank over range partitions). Neighbours in
that order are compared in windows: pieces of ``PIECE`` ranks with the first ``HALO`` of the next one.
A bucket of vectors that share their first ``depth`` signs, of log2(rows / PIECE), is compared in full:
where no window holds it, by pairs of its blocks. So a link is met in a pass with the chance that its
signs agree, (1 - acos(LEAST) / pi)^depth at least, however the vectors lie; the passes are as many as
keep the chance that all of them miss it under ``MISS``, ``PASSES`` at least and as many at once.
Verified links (cosine >= ``LEAST`` in double precision) of all passes are united to components.

An exact check follows: inside each component all members are compared, in pairs of blocks of bounded
size, so that ``n_links`` counts every link of a found component, whatever windows it fell into; no
pair is written out. Equal vectors are one class with a count from the start.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with
nothing, and so do vectors of different lengths. A null id links with nothing and has no component.
Rows that repeat an id are one vector, the smallest in array order. Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common as c
from corpuslab.operators.ranking import exact_rank

LEAST, PASSES, BITS, PIECE, HALO, BLOCK, SEED = 0.9, 12, 32, 512, 128, 1024, 20240501
MISS = 1e-4
_GOOD = ("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
         "and exists(embedding, x -> x <> 0) and id is not null")


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # scaled by the largest component first: squares neither overflow nor vanish
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a @ b.T) / np.outer(np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1)))


def plan(rows: int, least: float = LEAST) -> tuple[int, int]:
    """(depth, passes): signs of a bucket, and passes after which a link is missed with a chance below MISS."""
    depth = max(0, math.ceil(math.log2(max(1, rows) / PIECE)))
    met = (1 - math.acos(least) / math.pi) ** depth
    return depth, max(PASSES, math.ceil(math.log(MISS) / math.log1p(-met))) if met < 1 else PASSES


def _planes(size: int, number: int) -> np.ndarray:
    return np.random.default_rng((SEED + size, number)).normal(size=(size, BITS))


def _codes(vectors: DataFrame, first: int, last: int) -> DataFrame:
    passes = last - first

    def hash_(batches):
        for pdf in batches:
            for size, g in pdf.groupby(pdf["embedding"].map(len)):
                x = _matrix(g["embedding"])
                x /= np.abs(x).max(1, keepdims=True)
                planes = np.hstack([_planes(size, i) for i in range(first, last)])
                bits = (x @ planes > 0).reshape(len(g), passes, BITS)
                code = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pd.DataFrame({"id": np.repeat(g["id"].to_numpy(), passes), "dim": size, "pass": np.tile(np.arange(first, last), len(g)), "code": code.ravel()})

    return vectors.select("id", "embedding").mapInPandas(hash_, "id long, dim int, pass int, code long")


def _window_links(vectors: DataFrame, first: int, last: int, depth: int, least: float) -> DataFrame:
    """Links of the passes from first to before last."""
    ranked = c.checkpointed(exact_rank(_codes(vectors, first, last), ["code", "id"], partition_by=("pass", "dim"), name="rank").withColumn("bucket", F.shiftright("code", BITS - depth)))
    at = F.col("rank") - 1
    piece = F.floor(at / PIECE)
    both = F.when((piece > 0) & (at % PIECE < HALO), F.array(piece, piece - 1)).otherwise(F.array(piece))
    windows = ranked.select("id", "pass", "dim", F.lit(-1).cast("long").alias("bucket"), F.explode(both).alias("x"), F.lit(-1).cast("long").alias("y"))
    # buckets that no window holds: pairs of blocks, one block with itself if there is no other
    sizes = ranked.groupBy("pass", "dim", "bucket").agg(F.min(at).alias("low"), F.max(at).alias("high"))
    open_ = sizes.where(F.col("high") >= (F.floor(F.col("low") / PIECE) + 1) * PIECE + HALO)
    blocks = F.ceil((F.col("high") - F.col("low") + 1) / BLOCK)
    members = ranked.join(c.checkpointed(open_.withColumn("blocks", blocks)), ["pass", "dim", "bucket"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: (j != F.col("i")) | (F.col("blocks") == 1))
    pairs = F.transform(others, lambda j: F.struct(F.least("i", j).alias("x"), F.greatest("i", j).alias("y")))
    whole = members.select("id", "pass", "dim", "bucket", F.explode(pairs).alias("p")).select("id", "pass", "dim", "bucket", "p.x", "p.y")
    rows = windows.union(whole).join(vectors.select("id", "embedding"), "id")

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["id"].to_numpy(), _matrix(pdf["embedding"])
        near = _cosines(x, x) >= least
        np.fill_diagonal(near, True)
        label = ids.copy()
        while True:  # the smallest id of each group of linked rows: a spanning star, not all pairs
            lower = np.where(near, label[None], c.NULL_ID).min(1)
            if (lower == label).all():
                break
            label = lower
        return pd.DataFrame({"a": ids, "b": label})[label < ids]

    return rows.groupBy("pass", "dim", "bucket", "x", "y").applyInPandas(compare, "a long, b long").distinct()


def _count_links(vectors: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(id, links): rows linked with each member of a component, compared in pairs of blocks."""
    size = c.checkpointed(found.groupBy("component").agg(F.count("*").alias("m")))
    members = found.join(size, "component").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    members = members.withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("x"), F.greatest("i", j).alias("y")))
    rows = members.select("id", "component", "i", F.explode(pairs).alias("p")).select("id", "component", "i", "p.x", "p.y")
    rows = c.checkpointed(rows.join(vectors.select("id", "embedding", "copies"), "id"))
    groups = max(1, rows.count() // (2 * BLOCK))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("component", "x", "y"), F.lit(groups)))

    def count(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, x, y), g in pdf.groupby(["component", "x", "y"], sort=False):
            left, right = g[g["i"] == x], g[g["i"] == y]
            if not len(left) or not len(right):
                continue
            near = _cosines(_matrix(left["embedding"]), _matrix(right["embedding"])) >= least
            near &= left["id"].to_numpy()[:, None] != right["id"].to_numpy()[None]
            out.append(pd.DataFrame({"id": left["id"], "links": near @ right["copies"].to_numpy()}))
            if x != y:
                out.append(pd.DataFrame({"id": right["id"], "links": left["copies"].to_numpy() @ near}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "links": []})

    return dealt.groupBy("g").applyInPandas(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(embeddings: DataFrame, id_col="vec_id", vector_col="embedding", least=LEAST) -> DataFrame:
    """id, n_links, component_id, kept for every vector."""
    raw = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    nulls = raw.where("id is null").select("id")
    rows = raw.where("id is not null").groupBy("id").agg(F.min("embedding").alias("embedding"))
    good = F.expr(f"coalesce({_GOOD}, false)")
    rows = c.checkpointed(rows.withColumn("good", good).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding")))
    valid = rows.where("good")
    vectors = c.checkpointed(valid.groupBy("h1", "h2").agg(F.min(F.struct("id", "embedding")).alias("x"), F.count("*").alias("copies")).select("h1", "h2", "x.*", "copies"))
    depth, passes = plan(vectors.count(), least)
    links = None
    for first in range(0, passes, PASSES):
        more = _window_links(vectors, first, min(passes, first + PASSES), depth, least)
        links = c.checkpointed(more if links is None else links.union(more).distinct())
    found = c.components(links)
    linked = vectors.select("id", "h1", "h2", "copies").join(found, "id", "left").join(_count_links(vectors, found, least), "id", "left")
    classes = c.checkpointed(linked.select("h1", "h2", F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = valid.select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id").union(nulls).select("id", F.lit(0).cast("long").alias("n_links"), (F.col("id") + F.lit(0)).alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
    return out.withColumnRenamed("id", "vec_id")

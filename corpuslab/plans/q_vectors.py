"""Queries: vectors (embeddings table) - normalisation, norms, neighbours, drift, pooling."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import neighbours as nb
from corpuslab.operators import runlog as rl
from corpuslab.operators import vectors as vx
from corpuslab.operators.ranking import broadcast_if_small
from corpuslab.plans import sql as q
from corpuslab.plans import views
from corpuslab.plans.catalog import finish, register
from corpuslab.sources.tables import table

KNN = 5

_EL = """WITH el AS (SELECT vec_id, label, unnest(generate_series(1, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
"""


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@register(
    "l2_normalize",
    _EL + """, nr AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS nrm FROM el GROUP BY vec_id)
SELECT vec_id, dim, round(x / nrm, 6) AS value FROM el JOIN nr USING (vec_id)""",
)
def l2_normalize(spark: SparkSession, sf_dir: str):
    e = _emb(spark, sf_dir).select("vec_id", vx.l2_normalize("embedding").alias("v"))
    return finish(vx.to_long(e, ["vec_id"], "v").select("vec_id", F.col("dim").cast("bigint").alias("dim"), "value"))


@register(
    "rms_normalize",
    _EL + """, nr AS (SELECT vec_id, sqrt(sum(x * x) / count(*) + 1e-5) AS rms FROM el GROUP BY vec_id)
SELECT vec_id, dim, round(x / rms, 6) AS value FROM el JOIN nr USING (vec_id)""",
)
def rms_normalize(spark: SparkSession, sf_dir: str):
    e = _emb(spark, sf_dir).select("vec_id", vx.rms_normalize("embedding").alias("v"))
    return finish(vx.to_long(e, ["vec_id"], "v").select("vec_id", F.col("dim").cast("bigint").alias("dim"), "value"))


_NORM_SQL = _EL + """, g AS (SELECT label, sqrt(sum(x * x)) AS global_norm, max(abs(x)) AS max_abs FROM el GROUP BY label)
"""


@register("global_norm", _NORM_SQL + "SELECT label, round(global_norm, 6) AS global_norm FROM g")
def global_norm(spark: SparkSession, sf_dir: str):
    return finish(rl.global_norm(_emb(spark, sf_dir), ["label"], "embedding").select("label", "global_norm"))


@register("max_abs", _NORM_SQL + "SELECT label, round(max_abs, 6) AS max_abs FROM g")
def max_abs(spark: SparkSession, sf_dir: str):
    return finish(rl.global_norm(_emb(spark, sf_dir), ["label"], "embedding").select("label", "max_abs"))


@register(
    "clip_norm",
    _NORM_SQL + """SELECT label, round(global_norm, 6) AS global_norm, round(least(1.0, 1.0 / (global_norm + 1e-6)), 6) AS scale,
       round(global_norm * least(1.0, 1.0 / (global_norm + 1e-6)), 6) AS clipped_norm FROM g""",
)
def clip_norm(spark: SparkSession, sf_dir: str):
    g = rl.global_norm(_emb(spark, sf_dir), ["label"], "embedding")
    s = rl.clip_scale(F.col("global_norm"), 1.0)
    return finish(g.select("label", "global_norm", s.alias("scale"), (F.col("global_norm") * s).alias("clipped_norm")))


@register(
    "cosine_knn",
    f"""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS qid, b.vec_id AS nbr_id, list_cosine_similarity(a.e, b.e) AS sim FROM n a, n b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, nbr_id) AS rank FROM p)
SELECT qid, CAST(rank AS INTEGER) AS rank, nbr_id, round(sim, 6) AS sim FROM r WHERE rank <= {KNN}""",
)
def cosine_knn(spark: SparkSession, sf_dir: str):
    """Top-5 cosine neighbours of every vector (itself excluded), exact."""
    e = _emb(spark, sf_dir)
    return finish(vx.cosine_knn(e, e, KNN, drop="self"))


@register("cosine_knn_lsh")
def cosine_knn_lsh(spark: SparkSession, sf_dir: str):
    """Top-5 cosine neighbours of every vector (itself excluded) by probed buckets, with the recall that was
    measured against the exact search."""
    e = _emb(spark, sf_dir)
    return finish(nb.cosine_knn_lsh(e, e, KNN))


@register(
    "cosine_drift",
    _EL + """, m AS (SELECT label, dim, avg(x) AS m FROM el GROUP BY label, dim),
c AS (SELECT el.vec_id, el.label, sum(el.x * (el.x - m.m)) AS d, sqrt(sum(el.x * el.x)) AS na, sqrt(sum((el.x - m.m) * (el.x - m.m))) AS nb
      FROM el JOIN m USING (label, dim) GROUP BY el.vec_id, el.label)
SELECT label, count(*) AS n, round(avg(d / (na * nb)), 6) AS drift_cosine FROM c GROUP BY label""",
)
def cosine_drift(spark: SparkSession, sf_dir: str):
    """Drift between each vector and its label-centred version (mean cosine per label)."""
    e = _emb(spark, sf_dir)
    means = vx.pool_mean(e, "label", "embedding")
    marr = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("m"))
    b = e.join(broadcast_if_small(marr), "label").select(
        "vec_id", F.zip_with(vx.as_double("embedding"), F.col("m"), lambda x, y: x - y).alias("centred")
    )
    return finish(vx.cosine_drift(e, b, "vec_id", "embedding", "centred", by="label"))


@register("pool_mean", _EL + "SELECT label, dim, round(avg(x), 6) AS value FROM el GROUP BY label, dim")
def pool_mean(spark: SparkSession, sf_dir: str):
    p = vx.pool_mean(_emb(spark, sf_dir), "label", "embedding")
    return finish(p.select("label", F.col("dim").cast("bigint").alias("dim"), "value"))


@register(
    "pool_softmax",
    _EL + """, s AS (SELECT vec_id, label, sum(x) AS sc FROM el GROUP BY vec_id, label),
w AS (SELECT vec_id, label, exp(sc - max(sc) OVER (PARTITION BY label)) AS e FROM s),
ww AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY label) AS w FROM w)
SELECT el.label, el.dim, round(sum(ww.w * el.x), 6) AS value FROM el JOIN ww USING (vec_id, label) GROUP BY el.label, el.dim""",
)
def pool_softmax(spark: SparkSession, sf_dir: str):
    """Softmax-weighted pooling per label with score = sum of the vector's elements."""
    e = _emb(spark, sf_dir)
    score = F.aggregate(vx.as_double("embedding"), F.lit(0.0), lambda a, x: a + x)
    p = vx.pool_weighted(e, "label", "embedding", score)
    return finish(p.select("label", F.col("dim").cast("bigint").alias("dim"), "value"))


@register(
    "pool_attention",
    _EL + """, m AS (SELECT label, dim, avg(x) AS m FROM el GROUP BY label, dim),
s AS (SELECT el.vec_id, el.label, sum(el.x * m.m) / sqrt(count(*)) AS sc FROM el JOIN m USING (label, dim) GROUP BY el.vec_id, el.label),
w AS (SELECT vec_id, label, exp(sc - max(sc) OVER (PARTITION BY label)) AS e FROM s),
ww AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY label) AS w FROM w)
SELECT el.label, el.dim, round(sum(ww.w * el.x), 6) AS value FROM el JOIN ww USING (vec_id, label) GROUP BY el.label, el.dim""",
)
def pool_attention(spark: SparkSession, sf_dir: str):
    p = vx.pool_attention(_emb(spark, sf_dir), "label", "embedding")
    return finish(p.select("label", F.col("dim").cast("bigint").alias("dim"), "value"))


@register(
    "embed_lookup",
    q.with_(q.DOC_TOKS, q.TOK, q.VOCAB) + """, tok_ids AS (SELECT tok.doc_id, tok.pos, vocab.token_id FROM tok JOIN vocab USING (t)),
ev AS (SELECT vec_id, list_sum(embedding::DOUBLE[]) AS s FROM embeddings)
SELECT doc_id, count(*) AS n_hit, round(sum(ev.s), 6) AS vec_sum FROM tok_ids JOIN ev ON ev.vec_id = tok_ids.token_id GROUP BY doc_id""",
)
def embed_lookup(spark: SparkSession, sf_dir: str):
    """Token id -> vector lookup (the vector table is broadcast only under the row limit). Ids come in place, so that a
    document's tokens stay in one task and are added up there."""
    ids = views.doc_ids(spark, sf_dir).select("doc_id", F.explode("ids").alias("token_id"))
    e = _emb(spark, sf_dir).select(F.col("vec_id").alias("token_id"), F.aggregate(vx.as_double("embedding"), F.lit(0.0), lambda a, x: a + x).alias("s"))
    j = ids.join(broadcast_if_small(e), "token_id")
    return finish(j.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hit"), F.sum("s").alias("vec_sum")))

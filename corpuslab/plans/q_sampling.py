"""Queries: splitting, shuffling, batching, mixtures, grids and existence joins."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.hashing import draw, draw_sql
from corpuslab.operators import sampling as sm
from corpuslab.plans import sql as q
from corpuslab.plans import views
from corpuslab.plans.catalog import finish, register
from corpuslab.sources.tables import table

SEED = 42
VAL_FRAC = 0.1
EPOCHS = [1, 2]
BATCH = 16
MAX_STEPS = 20
MIX_P = 0.9
GRID_SAMPLE = 20


def _split(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    return sm.split_exact(docs.select("doc_id", "text"), VAL_FRAC, SEED, "doc_id")


@register("split_exact", q.with_(q.split(SEED, VAL_FRAC)) + "SELECT doc_id, split FROM split_t")
def split_exact(spark: SparkSession, sf_dir: str):
    return _split(spark, sf_dir).select("doc_id", "split")


@register(
    "split_overlap",
    q.with_(q.split(SEED, VAL_FRAC))
    + """, s AS (SELECT d.doc_id, d.text, t.split FROM documents d JOIN split_t t USING (doc_id))
SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val,
       count(*) FILTER (WHERE split = 'val' AND text IN (SELECT text FROM s WHERE split = 'train')) AS n_val_seen_in_train FROM s""",
)
def split_overlap(spark: SparkSession, sf_dir: str):
    """Leakage audit: validation documents whose exact text also occurs in training."""
    s = _split(spark, sf_dir).withColumn("h", F.md5("text"))
    train = s.where(F.col("split") == "train").select("h", "text").distinct()
    val = s.where(F.col("split") == "val")
    seen = val.join(train, ["h", "text"], "left_semi").agg(F.count(F.lit(1)).alias("n_val_seen_in_train"))
    counts = s.agg(
        F.count(F.when(F.col("split") == "train", 1)).alias("n_train"), F.count(F.when(F.col("split") == "val", 1)).alias("n_val")
    )
    return _one_row(counts, seen)


def _one_row(a, b):
    """Side-by-side of two single-row aggregates (each provably one row)."""
    ra, rb = a.first(), b.first()
    spark = a.sparkSession
    row = {**ra.asDict(), **rb.asDict()}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} bigint" for k in row))


def _shuffled(spark, sf_dir):
    docs = _split(spark, sf_dir).where(F.col("split") == "train").select("doc_id")
    ep = docs.select("doc_id", F.explode(F.array(*[F.lit(e) for e in EPOCHS])).alias("epoch"))
    return sm.shuffle_rank(ep, SEED, "epoch", "doc_id")


_SHUF_SQL = q.with_(q.split(SEED, VAL_FRAC)) + f""", ep AS (SELECT doc_id, epoch FROM split_t, (SELECT unnest([{', '.join(map(str, EPOCHS))}]) AS epoch) e
            WHERE split = 'train'),
sh AS (SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY {draw_sql(SEED, 'epoch', 'doc_id')}, doc_id) AS rank FROM ep),
bt AS (SELECT epoch, CAST((rank - 1) // {BATCH} AS BIGINT) AS batch_id, count(*) AS n FROM sh GROUP BY ALL)
"""


@register("epoch_shuffle", _SHUF_SQL + "SELECT epoch, doc_id, rank FROM sh")
def epoch_shuffle(spark: SparkSession, sf_dir: str):
    return _shuffled(spark, sf_dir).select("epoch", "doc_id", "rank")


@register("batch_sizes", _SHUF_SQL + "SELECT epoch, batch_id, n FROM bt")
def batch_sizes(spark: SparkSession, sf_dir: str):
    b = sm.batches(_shuffled(spark, sf_dir), BATCH)
    return b.groupBy("epoch", "batch_id").agg(F.count(F.lit(1)).alias("n"))


@register("cap_steps", _SHUF_SQL + f"SELECT epoch, batch_id, n FROM bt WHERE batch_id < {MAX_STEPS}")
def cap_steps(spark: SparkSession, sf_dir: str):
    b = sm.cap_steps(sm.batches(_shuffled(spark, sf_dir), BATCH), MAX_STEPS)
    return b.groupBy("epoch", "batch_id").agg(F.count(F.lit(1)).alias("n"))


def _pools(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    b = table(spark, sf_dir, "benchmark").select("item_id")
    return a, b


_MIX_SQL = f"""WITH pa AS (SELECT doc_id AS item_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents),
pb AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM benchmark),
nn AS (SELECT (SELECT count(*) FROM pa) AS na, (SELECT count(*) FROM pb) AS nb),
d AS (SELECT range AS draw_id FROM range((SELECT na + nb FROM nn))),
ds AS (SELECT draw_id, CASE WHEN {draw_sql(SEED, "'src'", 'draw_id')} <
              (CASE WHEN na = 0 THEN 0.0 WHEN nb = 0 THEN 1.0 ELSE {MIX_P} END) THEN 'a' ELSE 'b' END AS source, na, nb FROM d, nn),
di AS (SELECT draw_id, source, CAST(floor({draw_sql(SEED, "'idx'", 'draw_id')} * CASE WHEN source = 'a' THEN na ELSE nb END) AS BIGINT) AS idx FROM ds),
mx AS (SELECT di.draw_id, di.source, di.idx, coalesce(pa.item_id, pb.item_id) AS item_id FROM di
       LEFT JOIN pa ON di.source = 'a' AND pa.idx = di.idx LEFT JOIN pb ON di.source = 'b' AND pb.idx = di.idx)
"""


@register("mixture", _MIX_SQL + "SELECT draw_id, source, idx, item_id FROM mx")
def mixture(spark: SparkSession, sf_dir: str):
    a, b = _pools(spark, sf_dir)
    return sm.mix(a, b, MIX_P, SEED, "item_id")


@register(
    "mixture_share",
    _MIX_SQL + f"SELECT source, count(*) AS n, round(count(*) / (SELECT count(*) FROM mx), 6) AS share, "
    f"CAST(CASE WHEN source = 'a' THEN {MIX_P} ELSE round(1 - {MIX_P}, 6) END AS DOUBLE) AS target FROM mx GROUP BY source",
)
def mixture_share(spark: SparkSession, sf_dir: str):
    a, b = _pools(spark, sf_dir)
    m = sm.mix(a, b, MIX_P, SEED, "item_id")
    total = m.count()
    g = m.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return finish(g.select(
        "source", "n", (F.col("n") / F.lit(float(total))).alias("share"),
        F.when(F.col("source") == "a", F.lit(MIX_P)).otherwise(F.lit(1 - MIX_P)).alias("target"),
    ))


GRID_COLS = ["model_type", "activation", "k", "chunk_size"]

_GRID_KEY = "concat_ws('_', model_type, activation, k, chunk_size)"
_GRID_SQL = q.with_(q.RUNLOG) + ", grid AS (SELECT * FROM " + ", ".join(
    f"(SELECT DISTINCT {c} FROM runs) g{i}" for i, c in enumerate(GRID_COLS)
) + ")\n"


def _grid(spark, sf_dir):
    """Cartesian product of the distinct option values: the option lists are collected as small
    arrays in one aggregation, then expanded by successive explodes (no join)."""
    r = views.runs(spark, sf_dir)
    opts = r.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in GRID_COLS])
    g = opts
    for c in GRID_COLS:
        g = g.withColumn(c, F.explode(c))
    return g


@register("param_grid", _GRID_SQL + "SELECT * FROM grid")
def param_grid(spark: SparkSession, sf_dir: str):
    return _grid(spark, sf_dir)


@register(
    "grid_sample",
    _GRID_SQL + f"SELECT * FROM grid ORDER BY {draw_sql(SEED, _GRID_KEY)}, {_GRID_KEY} LIMIT {GRID_SAMPLE}",
)
def grid_sample(spark: SparkSession, sf_dir: str):
    g = _grid(spark, sf_dir).withColumn("key", F.concat_ws("_", *[F.col(c).cast("string") for c in GRID_COLS]))
    return g.withColumn("_u", draw(SEED, "key")).orderBy("_u", "key").limit(GRID_SAMPLE).select(*GRID_COLS)


GRID_PICK = 10  # untried combinations that are started


@register(
    "grid_untried",
    _GRID_SQL + f""", s AS (SELECT * FROM grid ORDER BY {draw_sql(SEED, _GRID_KEY)}, {_GRID_KEY} LIMIT {GRID_SAMPLE}),
tried AS (SELECT {", ".join(GRID_COLS)} FROM runs WHERE run % 2 = 0)
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM tried t WHERE {" AND ".join(f"t.{c} = s.{c}" for c in GRID_COLS)})
ORDER BY {draw_sql(SEED, _GRID_KEY)}, {_GRID_KEY} LIMIT {GRID_PICK}""",
)
def grid_untried(spark: SparkSession, sf_dir: str):
    """Random search: of the sampled grid, up to ten combinations that no run has tried yet (the runs with an even
    number stand for those that are done)."""
    key = F.concat_ws("_", *[F.col(c).cast("string") for c in GRID_COLS])
    sample = grid_sample(spark, sf_dir)
    tried = views.runs(spark, sf_dir).where(F.col("run") % 2 == 0).select(*GRID_COLS)
    open_ = sample.join(tried, GRID_COLS, "left_anti").withColumn("key", key)
    return open_.withColumn("_u", draw(SEED, "key")).orderBy("_u", "key").limit(GRID_PICK).select(*GRID_COLS)


@register("has_artifact", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def has_artifact(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@register("missing_artifact", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_artifact(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")

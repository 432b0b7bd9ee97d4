"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a target share; its mean repetition rate is share x wanted rows / its rows. A
document's count is the inverse of the Poisson distribution with that mean at a uniform number drawn
from a hash of (seed, id); the document is exploded by its count and all copies are dealt and sorted
by a hash of (seed, id, copy): a global shuffle. Every draw depends on the row alone, so a lost
executor's work comes out the same again.

Weights: a column expression of the source's row count ``n`` and name ``s`` (the query: square root
of n, which lowers a source that holds a third of all rows). Rates are a table of one row a source;
it is broadcast only if it has at most ``broadcast_rows`` rows, else joined by a shuffle.

Defined results: null sources are one source. A null id draws by its text (a null text: by the empty
text); rows that repeat an id repeat its count. An empty table stays empty; null texts are mixed like
others; extra columns are kept. Source columns of the result are the input's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common as c

SEED, BROADCAST_ROWS = "mix-1", 10_000


def _number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def _tag(id_col: str, text_col: str | None) -> Column:
    by_text = F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))) if text_col else F.lit("null")
    return F.coalesce(F.col(id_col).cast("string"), by_text)


def rates(docs: DataFrame, source_col: str, weight: Column, rows: int | None = None) -> DataFrame:
    """_s (source), _rate (mean copies) and _cdf (Poisson distribution function at 0, 1, ...)."""
    n = c.checkpointed(docs.groupBy(F.col(source_col).alias("s")).agg(F.count("*").alias("n")).withColumn("w", weight.cast("double")))
    total = n.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    wanted, w = float(rows if rows is not None else total["n"] or 0), float(total["w"] or 1.0)
    rate = F.lit(wanted) * (F.col("w") / F.lit(w)) / F.col("n")
    with_rate = n.select(F.col("s").alias("_s"), rate.alias("_rate"))
    # terms to far beyond the mean: the rest is below the draw's resolution
    last = F.ceil(F.col("_rate") + 12 * F.sqrt("_rate") + 40).cast("int")
    start = F.struct(F.lit(0.0).alias("log_fact"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf"))

    def step(acc, k):
        log_fact = acc["log_fact"] + F.when(k > 0, F.log(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0)
        total = acc["sum"] + F.exp(k * F.log("_rate") - F.col("_rate") - log_fact)
        return F.struct(log_fact.alias("log_fact"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc["cdf"])
    return with_rate.withColumn("_cdf", F.when(F.col("_rate") > 0, cdf).otherwise(F.array(F.lit(1.0))))


def replicate(docs: DataFrame, weight: Column | None = None, id_col="doc_id", source_col="source", text_col="text",
              seed=SEED, rows: int | None = None, broadcast_rows=BROADCAST_ROWS, made=("_copy", "_place")) -> DataFrame:
    """All columns as they are, the number of the copy (from 1) and its place (the shuffle's key) in columns ``made``
    (under the next free names if they are columns already), dealt and sorted by place."""
    has_text = text_col in docs.columns
    own, original = (id_col, source_col, text_col), docs.columns
    docs, names = c.shielded(docs, own)
    table = c.checkpointed(rates(docs, source_col, weight if weight is not None else F.sqrt("n"), rows))
    table = F.broadcast(table) if table.count() <= broadcast_rows else table
    tag = _tag(id_col, text_col if has_text else None)
    joined = docs.join(table, docs[source_col].eqNullSafe(table["_s"]))
    draw = _number(F.concat(F.lit(f"{seed}|"), tag), 13) / F.lit(float(1 << 52))
    counted = joined.withColumn("_n", F.size(F.filter("_cdf", lambda p: p <= draw))).where("_n > 0").drop("_s", "_rate", "_cdf")
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    place = _number(F.concat(F.lit(f"{seed}|order|"), tag, F.lit("|"), F.col("_copy").cast("string")), 15)
    mixed = copies.withColumn("_place", place)
    mixed = mixed.repartition("_place").sortWithinPartitions("_place")
    made = {k: c.fresh(original, x) for k, x in zip(("_copy", "_place"), made)}
    return mixed.withColumnsRenamed(made | names).select(*[f"`{x}`" for x in original], *made.values())


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    out = replicate(docs)
    return out.select("doc_id", "text", "lang", "source", F.col("_copy").alias("copy"), F.col("_place").alias("place"))


ORACLE = f"""
WITH n AS (SELECT source AS s, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT s, (SELECT sum(n) FROM n) * (sqrt(n) / (SELECT sum(sqrt(n)) FROM n)) / n AS rate FROM n),
terms AS (SELECT s, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT))) AS k FROM r),
logs AS (SELECT s, k, k * ln(rate) - rate - sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END)
         OVER (PARTITION BY s ORDER BY k) AS lp FROM terms),
cdf AS (SELECT s, k, sum(exp(lp)) OVER (PARTITION BY s ORDER BY k) AS p FROM logs),
u AS (SELECT d.*, ('0x' || substr(md5('{SEED}|' || CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0 AS u
      FROM documents d),
n_of AS (SELECT doc_id, count(*) AS cnt FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.s AND cdf.p <= u.u GROUP BY doc_id),
c AS (SELECT u.*, cnt FROM u JOIN n_of USING (doc_id)),
e AS (SELECT doc_id, text, lang, source, CAST(unnest(generate_series(1, cnt)) AS INTEGER) AS copy FROM c)
SELECT doc_id, text, lang, source, copy,
       ('0x' || substr(md5('{SEED}|order|' || CAST(doc_id AS VARCHAR) || '|' || CAST(copy AS VARCHAR)), 1, 15))::BIGINT AS place
FROM e
"""

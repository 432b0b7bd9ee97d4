"""Queries: statistics across runs (the ``runs`` view: one row per run)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.operators import stats as st
from corpuslab.operators.frontier import skyline as skyline_nd
from corpuslab.operators.scorer import TreeScorer, score_rows
from corpuslab.plans import sql as q
from corpuslab.plans import views
from corpuslab.plans.catalog import finish, register

RL = q.with_(q.RUNLOG)
NUMERIC = ["val_loss", "avg_loss", "perplexity", "token_accuracy", "max_loss", "learning_rate", "embed_size", "k",
           "chunk_size", "inner_layers", "block_size", "batch_size", "tinystories_weight"]
K_VALUES = [1, 2, 3, 4, 5]


def _runs(spark, sf_dir):
    r = views.runs(spark, sf_dir)
    return r.withColumn("learning_rate", F.col("learning_rate").cast("double")).withColumn(
        "tinystories_weight", F.col("tinystories_weight").cast("double")
    )


def _complete(spark, sf_dir):
    return _runs(spark, sf_dir).where(F.col("val_loss").isNotNull())


_RN = RL + """, rn AS (SELECT * REPLACE (CAST(learning_rate AS DOUBLE) AS learning_rate, CAST(tinystories_weight AS DOUBLE) AS tinystories_weight) FROM runs),
rc AS (SELECT * FROM rn WHERE val_loss IS NOT NULL)
"""


def _corr_sql() -> str:
    parts = []
    for a, b in combinations(NUMERIC, 2):
        x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
        parts.append(
            f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({x}, {y}) AS r, min({x}) AS x0, max({x}) AS x1, min({y}) AS y0, max({y}) AS y1 FROM rn WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        )
    return _RN + ", g AS (" + "\nUNION ALL ".join(parts) + """)
SELECT a, b, n, round(CASE WHEN n >= 2 AND x0 <> x1 AND y0 <> y1 THEN r END, 6) + 0.0 AS corr FROM g"""


@register("corr_matrix", _corr_sql())
def corr_matrix(spark: SparkSession, sf_dir: str):
    # + 0.0: no negative zero
    return finish(st.corr_matrix(_runs(spark, sf_dir), NUMERIC)).withColumn("corr", F.col("corr") + F.lit(0.0))


@register(
    "median_order",
    _RN + """SELECT activation, count(*) AS n, round(quantile_cont(val_loss, 0.5), 6) AS median,
       row_number() OVER (ORDER BY quantile_cont(val_loss, 0.5), activation) AS ord FROM rc GROUP BY activation""",
)
def median_order(spark: SparkSession, sf_dir: str):
    return finish(st.median_order(_complete(spark, sf_dir), "activation", "val_loss"))


_BOX_SQL = _RN + """, qs AS (SELECT activation, model_type, count(*) AS n, quantile_cont(val_loss, 0.25) AS q25,
       quantile_cont(val_loss, 0.5) AS q50, quantile_cont(val_loss, 0.75) AS q75 FROM rc GROUP BY ALL),
f AS (SELECT *, q75 - q25 AS iqr, q25 - 1.5 * (q75 - q25) AS lo_fence, q75 + 1.5 * (q75 - q25) AS hi_fence FROM qs),
j AS (SELECT rc.run, rc.val_loss, f.*, rc.val_loss >= f.lo_fence AND rc.val_loss <= f.hi_fence AS inside
      FROM rc JOIN f USING (activation, model_type))
"""


@register(
    "box_stats",
    _BOX_SQL + """SELECT activation, model_type, any_value(n) AS n, round(any_value(q25), 6) AS q25, round(any_value(q50), 6) AS q50,
       round(any_value(q75), 6) AS q75, round(any_value(iqr), 6) AS iqr,
       round(min(CASE WHEN inside THEN val_loss END), 6) AS lo_whisker, round(max(CASE WHEN inside THEN val_loss END), 6) AS hi_whisker,
       CAST(sum(CASE WHEN inside THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers FROM j GROUP BY activation, model_type""",
)
def box_stats(spark: SparkSession, sf_dir: str):
    s, _ = st.box_stats(_complete(spark, sf_dir), ["activation", "model_type"], "val_loss")
    return finish(s)


@register("box_outliers", _BOX_SQL + "SELECT run, activation, model_type, round(val_loss, 6) AS val_loss FROM j WHERE NOT inside")
def box_outliers(spark: SparkSession, sf_dir: str):
    _, o = st.box_stats(_complete(spark, sf_dir), ["activation", "model_type"], "val_loss")
    return finish(o.select("run", "activation", "model_type", "val_loss"))


@register(
    "heatmap_long",
    _RN + "SELECT model_type, embed_size, k, count(*) AS n, round(avg(val_loss), 6) AS val_loss FROM rc GROUP BY ALL",
)
def heatmap_long(spark: SparkSession, sf_dir: str):
    r = _complete(spark, sf_dir)
    return finish(r.groupBy("model_type", "embed_size", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("val_loss").alias("val_loss")))


@register(
    "heatmap_pivot",
    _RN + "SELECT model_type, embed_size, "
    + ", ".join(f"round(avg(CASE WHEN k = {v} THEN val_loss END), 6) AS k{v}" for v in K_VALUES)
    + " FROM rc GROUP BY model_type, embed_size",
)
def heatmap_pivot(spark: SparkSession, sf_dir: str):
    return finish(st.pivot_mean(_complete(spark, sf_dir), ["model_type"], "embed_size", "k", K_VALUES, "val_loss"))


@register(
    "fit_lines",
    _RN + """, g AS (SELECT model_type, activation, count(*) AS n, covar_pop(embed_size, val_loss) AS cxy, var_pop(embed_size) AS vx,
       var_pop(val_loss) AS vy, avg(embed_size) AS mx, avg(val_loss) AS my FROM rc GROUP BY ALL)
SELECT model_type, activation, n, round(CASE WHEN vx > 0 THEN cxy / vx END, 6) AS slope,
       round(my - (CASE WHEN vx > 0 THEN cxy / vx END) * mx, 6) AS intercept,
       round(CASE WHEN vx > 0 AND vy > 0 THEN cxy * cxy / (vx * vy) END, 6) AS r2 FROM g""",
)
def fit_lines(spark: SparkSession, sf_dir: str):
    return finish(st.fit_lines(_complete(spark, sf_dir), "embed_size", "val_loss", ["model_type", "activation"]))


@register(
    "scatter_data",
    _RN + "SELECT run, model_type, activation, round(val_loss, 6) AS val_loss, round(token_accuracy, 6) AS token_accuracy FROM rc",
)
def scatter_data(spark: SparkSession, sf_dir: str):
    return finish(_complete(spark, sf_dir).select("run", "model_type", "activation", "val_loss", "token_accuracy"))


@register(
    "log_scatter",
    _RN + "SELECT run, round(log10(perplexity), 6) AS log_perplexity, round(token_accuracy, 6) AS token_accuracy FROM rn WHERE perplexity IS NOT NULL",
)
def log_scatter(spark: SparkSession, sf_dir: str):
    r = _runs(spark, sf_dir).where(F.col("perplexity").isNotNull())
    return finish(r.select("run", F.log10("perplexity").alias("log_perplexity"), "token_accuracy"))


@register(
    "hist2d",
    _RN + """, rg AS (SELECT min(val_loss) AS lo, max(val_loss) AS hi FROM rc)
SELECT CAST(least(greatest(floor((token_accuracy - 0.0) / 0.1), 0), 9) AS INTEGER) AS bx,
       CAST(least(greatest(floor((val_loss - rg.lo) / (CASE WHEN rg.hi > rg.lo THEN (rg.hi - rg.lo) / 10 ELSE 1.0 END)), 0), 9) AS INTEGER) AS by,
       count(*) AS n
FROM rc, rg WHERE token_accuracy IS NOT NULL GROUP BY ALL""",
)
def hist2d(spark: SparkSession, sf_dir: str):
    r = _complete(spark, sf_dir)
    return st.hist2d(r, "token_accuracy", "val_loss", 10, (0.0, 1.0), st.data_range(r, "val_loss"))


@register(
    "describe_by",
    _RN + """SELECT model_type, count(*) AS n, """
    + ", ".join(
        f"round(min({m}), 6) AS {m}_min, round(quantile_cont({m}, 0.5), 6) AS {m}_median, round(avg({m}), 6) AS {m}_mean, round(max({m}), 6) AS {m}_max"
        for m in ["val_loss", "token_accuracy"]
    )
    + " FROM rc GROUP BY model_type",
)
def describe_by(spark: SparkSession, sf_dir: str):
    return finish(st.describe_by(_complete(spark, sf_dir), "model_type", ["val_loss", "token_accuracy"]))


# OLS val_loss ~ 1 + C(activation) + embed_size; SQL solves the centred 2x2 normal equations.
_OLS_SQL = _RN + """, m AS (SELECT avg(CASE WHEN activation = 'relu' THEN 1.0 ELSE 0.0 END)::DOUBLE AS m1, avg(embed_size)::DOUBLE AS m2, avg(val_loss) AS my FROM rc),
c AS (SELECT sum((d1 - m1) * (d1 - m1)) AS s11, sum((embed_size - m2) * (embed_size - m2)) AS s22, sum((d1 - m1) * (embed_size - m2)) AS s12,
             sum((d1 - m1) * (val_loss - my)) AS s1y, sum((embed_size - m2) * (val_loss - my)) AS s2y, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my
      FROM (SELECT *, CASE WHEN activation = 'relu' THEN 1.0 ELSE 0.0 END::DOUBLE AS d1 FROM rc), m),
b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM c),
coef AS (SELECT my - b1 * m1 - b2 * m2 AS b0, b1, b2, m1, m2 FROM b)
"""


# Standard errors from the same system; p by Simpson's rule on the tail (t = sqrt(v) tan a); the interval's quantile
# by its expansion in 1 / degrees of freedom.
_OLS_TABLE_SQL = _OLS_SQL + """, e AS (SELECT count(*)::DOUBLE AS n, sum(pow(val_loss - (b0 + b1 * (CASE WHEN activation = 'relu' THEN 1.0 ELSE 0.0 END) + b2 * embed_size), 2)) AS ssr FROM rc, coef),
v AS (SELECT n - 3 AS dof, ssr / (n - 3) AS s2, n, s11, s22, s12, s11 * s22 - s12 * s12 AS det, m1, m2 FROM e, c),
terms AS (
  SELECT 'Intercept' AS term, b0 AS coef, sqrt(s2 * (1 / n + (v.m1 * v.m1 * s22 - 2 * v.m1 * v.m2 * s12 + v.m2 * v.m2 * s11) / det)) AS se, dof FROM coef, v
  UNION ALL SELECT 'activation[T.relu]', b1, sqrt(s2 * s22 / det), dof FROM coef, v
  UNION ALL SELECT 'embed_size', b2, sqrt(s2 * s11 / det), dof FROM coef, v),
tail AS (SELECT term, 1 - 2 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi()) * sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(a * i / 4000), dof - 1)) * any_value(a) / 12000 AS p
  FROM (SELECT term, dof, atan(abs(coef / se) / sqrt(dof)) AS a, unnest(range(4001)) AS i FROM terms) GROUP BY term, dof),
q AS (SELECT term, z + (pow(z, 3) + z) / 4 / dof + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / 96 / pow(dof, 2) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / 384 / pow(dof, 3)
        + (79 * pow(z, 9) + 776 * pow(z, 7) + 1482 * pow(z, 5) - 1920 * pow(z, 3) - 945 * z) / 92160 / pow(dof, 4) AS tq FROM (SELECT term, dof, 1.959963984540054::DOUBLE AS z FROM terms))
SELECT term, round(coef, 6) AS coef, round(se, 6) AS se, round(coef / se, 6) AS t, abs(round(p, 6)) AS p, round(coef - tq * se, 6) AS ci_low, round(coef + tq * se, 6) AS ci_high
FROM terms JOIN tail USING (term) JOIN q USING (term)"""

# Fit statistics; the condition number from the eigenvalues of the 3 x 3 matrix of cross products: the largest by the
# trigonometric form, the smallest by the quadratic of the other two.
_OLS_REPORT_SQL = _OLS_SQL + """, r AS (SELECT run, val_loss AS y, embed_size::DOUBLE AS x, d, val_loss - (b0 + b1 * d + b2 * embed_size) AS e
  FROM (SELECT *, CASE WHEN activation = 'relu' THEN 1.0 ELSE 0.0 END::DOUBLE AS d FROM rc), coef),
u AS (SELECT *, lead(e) OVER (ORDER BY run) - e AS de FROM r),
s AS (SELECT count(*)::DOUBLE AS n, sum(e * e) AS ssr, var_pop(y) * count(*) AS sst, avg(pow(e, 2)) AS c2, avg(pow(e, 3)) AS c3, avg(pow(e, 4)) AS c4, sum(de * de) AS num,
             sum(d) AS sd, sum(x) AS sx, sum(d * x) AS sdx, sum(x * x) AS sxx FROM u),
g AS (SELECT *, 1 - ssr / sst AS r2, -n / 2 * (ln(2 * pi()) + ln(ssr / n) + 1) AS llf, c3 / pow(c2, 1.5) AS skew, c4 / (c2 * c2) AS kurt, (n + sd + sxx) / 3 AS q,
             n * (sd * sxx - sdx * sdx) - sd * (sd * sxx - sdx * sx) + sx * (sd * sdx - sd * sx) AS det, n * sd - sd * sd + n * sxx - sx * sx + sd * sxx - sdx * sdx AS i2 FROM s),
h AS (SELECT *, sqrt((pow(n - q, 2) + pow(sd - q, 2) + pow(sxx - q, 2) + 2 * (sd * sd + sx * sx + sdx * sdx)) / 6) AS pp FROM g),
k AS (SELECT *, q + 2 * pp * cos(acos(least(1, ((n - q) * ((sd - q) * (sxx - q) - sdx * sdx) - sd * (sd * (sxx - q) - sdx * sx) + sx * (sd * sdx - (sd - q) * sx)) / pow(pp, 3) / 2)) / 3) AS e1 FROM h),
w AS (SELECT *, (i2 - det / e1) / e1 AS es, det / e1 AS ep FROM k)
SELECT n, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adj_r2, round((r2 / 2) / ((1 - r2) / (n - 3)), 6) AS f, round(llf, 6) AS llf,
       round(-2 * llf + 6, 6) AS aic, round(-2 * llf + 3 * ln(n), 6) AS bic, round(skew, 6) AS skew, round(kurt, 6) AS kurtosis,
       round(n / 6 * (skew * skew + pow(kurt - 3, 2) / 4), 6) AS jb, round(num / ssr, 6) AS dw, round(sqrt(e1 * (es + sqrt(es * es - 4 * ep)) / 2 / ep), 4) AS cond
FROM w WHERE n >= 5"""


def _fit(spark, sf_dir, order_col=None):
    r = _complete(spark, sf_dir)
    return r, st.ols(r, "val_loss", ["embed_size"], "activation", order_col=order_col)


@register(
    "ols_coef",
    _OLS_SQL + """SELECT 'Intercept' AS term, round(b0, 6) AS coef FROM coef
UNION ALL SELECT 'activation[T.relu]', round(b1, 6) FROM coef UNION ALL SELECT 'embed_size', round(b2, 6) FROM coef""",
)
def ols_coef(spark: SparkSession, sf_dir: str):
    _, fit = _fit(spark, sf_dir)
    return finish(st.coef_frame(spark, fit).select("term", "coef"))


@register(
    "ols_residuals",
    _OLS_SQL + """SELECT run, round(b0 + b1 * (CASE WHEN activation = 'relu' THEN 1.0 ELSE 0.0 END) + b2 * embed_size, 6) AS fitted,
       round(val_loss - (b0 + b1 * (CASE WHEN activation = 'relu' THEN 1.0 ELSE 0.0 END) + b2 * embed_size), 6) AS resid FROM rc, coef""",
)
def ols_residuals(spark: SparkSession, sf_dir: str):
    r, fit = _fit(spark, sf_dir)
    f = st.fitted_expr(fit, "activation", ["embed_size"])
    return finish(r.select("run", f.alias("fitted"), (F.col("val_loss") - f).alias("resid")))


@register(
    "linear_shap",
    _OLS_SQL + """SELECT run, round(b1 * ((CASE WHEN activation = 'relu' THEN 1.0 ELSE 0.0 END) - m1), 6) AS phi_relu,
       round(b2 * (embed_size - m2), 6) AS phi_embed_size FROM rc, coef""",
)
def linear_shap(spark: SparkSession, sf_dir: str):
    r, fit = _fit(spark, sf_dir)
    phi = st.linear_shap(r, fit, "activation", ["embed_size"])
    return finish(phi.select("run", F.col("`phi_activation[T.relu]`").alias("phi_relu"), "phi_embed_size"))


@register("ols_table", _OLS_TABLE_SQL)
def ols_table(spark: SparkSession, sf_dir: str):
    """Coefficient table: standard error, t, two-sided p and 95% interval of every term."""
    _, fit = _fit(spark, sf_dir)
    return finish(st.coef_frame(spark, fit))


@register("ols_report", _OLS_REPORT_SQL)
def ols_report(spark: SparkSession, sf_dir: str):
    """Full regression report (one row of fit statistics): R2, adjusted R2, F, log-likelihood,
    AIC, BIC, skew, kurtosis, Jarque-Bera, Durbin-Watson (runs in run order), condition number."""
    _, fit = _fit(spark, sf_dir, order_col="run")
    return finish(st.report_frame(spark, fit), cond=4)


@register(
    "top_runs",
    _RN + "SELECT config_name, round(val_loss, 6) AS val_loss, model_type FROM rc ORDER BY val_loss, config_name LIMIT 10",
)
def top_runs(spark: SparkSession, sf_dir: str):
    r = _complete(spark, sf_dir)
    return finish(r.orderBy("val_loss", "config_name").limit(10).select("config_name", "val_loss", "model_type"))


@register(
    "rank_runs",
    _RN + """SELECT config_name, round(val_loss, 6) AS val_loss, row_number() OVER (ORDER BY val_loss, config_name) AS rank
FROM rc ORDER BY val_loss, config_name LIMIT 10""",
)
def rank_runs(spark: SparkSession, sf_dir: str):
    top = _complete(spark, sf_dir).orderBy("val_loss", "config_name").limit(10)
    # ten rows after the top-k prune: a global window over them is bounded
    return finish(top.select("config_name", "val_loss", F.row_number().over(Window.orderBy("val_loss", "config_name")).cast("bigint").alias("rank")))


@register(
    "skyline",
    _RN + """SELECT p.run, round(p.val_loss, 6) AS val_loss, round(p.token_accuracy, 6) AS token_accuracy FROM rc p
WHERE p.token_accuracy IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM rc q WHERE q.token_accuracy IS NOT NULL AND q.val_loss <= p.val_loss AND q.token_accuracy >= p.token_accuracy
    AND (q.val_loss < p.val_loss OR q.token_accuracy > p.token_accuracy))""",
)
def skyline(spark: SparkSession, sf_dir: str):
    r = _complete(spark, sf_dir).where(F.col("token_accuracy").isNotNull())
    return finish(st.skyline_2d(r, "val_loss", "token_accuracy").select("run", "val_loss", "token_accuracy"))


@register(
    "skyline_3d",
    _RN + """SELECT p.run, round(p.val_loss, 6) AS val_loss, p.embed_size, round(p.token_accuracy, 6) AS token_accuracy FROM rc p
WHERE p.token_accuracy IS NOT NULL AND p.embed_size IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM rc q WHERE q.val_loss <= p.val_loss AND q.embed_size <= p.embed_size AND q.token_accuracy >= p.token_accuracy
    AND (q.val_loss < p.val_loss OR q.embed_size < p.embed_size OR q.token_accuracy > p.token_accuracy))""",
)
def skyline_3d(spark: SparkSession, sf_dir: str):
    """Runs that no other run beats in loss, model size and accuracy together."""
    r = _complete(spark, sf_dir).select("run", "val_loss", "embed_size", "token_accuracy")
    return finish(skyline_nd(r, ["val_loss", "embed_size"], ["token_accuracy"]))


@register("hull")
def hull(spark: SparkSession, sf_dir: str):
    """Convex-hull vertices of (val_loss, token_accuracy), the frontier as drawn."""
    return finish(st.hull(_complete(spark, sf_dir), "val_loss", "token_accuracy"))


GBT_FEATURES = ["avg_loss", "perplexity", "token_accuracy", "learning_rate", "embed_size", "k", "chunk_size", "inner_layers", "block_size",
                "batch_size", "tinystories_weight"]


def _gbt(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    r = _complete(spark, sf_dir).na.fill(0.0, subset=GBT_FEATURES)
    va = VectorAssembler(inputCols=GBT_FEATURES, outputCol="features")
    model = GBTRegressor(labelCol="val_loss", featuresCol="features", maxIter=20, maxDepth=3, seed=42).fit(va.transform(r))
    return r, model


@register("gbt_importance")
def gbt_importance(spark: SparkSession, sf_dir: str):
    """Boosted-tree feature importances for val_loss over the numeric metric and configuration columns."""
    _, model = _gbt(spark, sf_dir)
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(GBT_FEATURES, imp)], "feature string, importance double")


@register("shapley_rows")
def shapley_rows(spark: SparkSession, sf_dir: str):
    """Per-run, per-feature permutation Shapley values of the boosted-tree model (reference =
    feature means); per run the values add up to prediction - base."""
    r, model = _gbt(spark, sf_dir)
    return finish(st.shapley_permutation(r, model, GBT_FEATURES, "run"))


@register("tree_attribution")
def tree_attribution(spark: SparkSession, sf_dir: str):
    """Exact path-dependent Shapley values of the boosted-tree model per run and feature, with prediction and base."""
    r, model = _gbt(spark, sf_dir)
    return finish(st.tree_attribution(r, model, GBT_FEATURES, "run"))


@register("scorer_trees")
def scorer_trees(spark: SparkSession, sf_dir: str):
    """Predictions of the boosted-tree model per run through the pluggable scorer (numpy over Arrow batches)."""
    r, model = _gbt(spark, sf_dir)
    return finish(score_rows(r, TreeScorer(model, GBT_FEATURES), ["run", "val_loss"]))

"""Cross-run statistics: correlation, quantiles, box statistics, pivots, regression lines,
2-D histograms, OLS with a full report, linear attribution, top-k, Pareto skyline, hull.

Every statistic is one or two distributed aggregation passes; only fixed-size results (a
k x k cross-product matrix, per-partition maxima, per-group quantiles) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.ranking import broadcast_if_small, exact_rank, running_total
from corpuslab.session import ensure_checkpoint_dir


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation for every column pair on pairwise-complete rows; NULL when either
    column is constant on those rows or fewer than 2 rows remain (never an exception).
    Each row fans out to a fixed k(k-1)/2 column pairs, then one grouped aggregation."""
    pairs = list(combinations(cols, 2))
    arr = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _d(a).alias("x"), _d(b).alias("y")) for a, b in pairs
    ])
    long = df.select(F.inline(arr)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    x, y = F.col("x"), F.col("y")
    g = long.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("xy"),  # centred moments: offsets cost no digits
        (F.stddev_pop(x) * F.stddev_pop(y)).alias("sd"),
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"),
    )
    ok = (F.col("n") >= 2) & (F.col("x0") != F.col("x1")) & (F.col("y0") != F.col("y1"))
    return g.select("a", "b", "n", F.when(ok, F.try_divide("xy", "sd")).alias("corr"))


def quantiles(df: DataFrame, by: Sequence[str], v: str, probs=(0.25, 0.5, 0.75), exact: bool = True) -> DataFrame:
    """Per-group quantiles with linear interpolation (exact), or the approximate sketch.

    Exact quantiles count each group's distinct values first, so a value that repeats in millions
    of rows is one row, and take the running count over them (``running_total``): the order
    statistics around a quantile are the values whose counts cover its two ranks. No group is ever
    held in one task, whatever its size."""
    data = df.where(F.col(v).isNotNull())
    names = [f"q{int(round(p * 100))}" for p in probs]
    if not exact:
        g = data.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(_d(v), list(probs), 10000).alias("q"))
        return g.select(*by, "n", *[F.col("q")[i].alias(nm) for i, nm in enumerate(names)])
    keys = [f"_b{i}" for i in range(len(by))]
    # null group keys are groups too: a struct of the keys joins where plain null keys would not
    values = data.groupBy(F.struct(F.lit(0).alias("_"), *by).alias("_by"), _d(v).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = running_total(values, ["_v"], "_c", partition_by=("_by",), name="_upto")
    sizes = upto.groupBy("_by").agg(F.sum("_c").alias("n"))
    ranked = upto.join(broadcast_if_small(sizes), "_by")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_c") < rank) & (rank <= F.col("_upto")), F.col("_v")))

    ranks = [F.lit(p) * (F.col("n") - 1) + 1 for p in probs]
    found = ranked.groupBy("_by", "n").agg(*[f(at(g(h))).alias(f"{k}{i}") for i, h in enumerate(ranks)
                                             for k, f, g in (("lo", lambda x: x, F.floor), ("hi", lambda x: x, F.ceil))])
    out = [F.col(f"lo{i}") + (h - F.floor(h)) * (F.col(f"hi{i}") - F.col(f"lo{i}")) for i, h in enumerate(ranks)]
    return found.select(*[F.col("_by")[c].alias(c) for c in by], "n", *[o.alias(nm) for o, nm in zip(out, names)])


def median_order(df: DataFrame, by: str, v: str) -> DataFrame:
    """Exact group medians, groups ordered by median (ties by group)."""
    med = quantiles(df, [by], v, (0.5,)).withColumnRenamed("q50", "median")
    from pyspark.sql import Window

    # one row per group: the ordering window runs over the (small) group table
    return med.withColumn("ord", F.row_number().over(Window.orderBy("median", by)).cast("bigint"))


def box_stats(df: DataFrame, by: Sequence[str], v: str) -> tuple[DataFrame, DataFrame]:
    """Box statistics per group: quartiles, IQR, whiskers (furthest points inside 1.5 IQR) and
    the outlier rows. Returns (stats, outliers)."""
    q = quantiles(df, by, v).withColumn("iqr", F.col("q75") - F.col("q25"))
    q = q.withColumn("lo_fence", F.col("q25") - 1.5 * F.col("iqr")).withColumn("hi_fence", F.col("q75") + 1.5 * F.col("iqr"))
    j = df.join(broadcast_if_small(q), list(by))
    inside = (_d(v) >= F.col("lo_fence")) & (_d(v) <= F.col("hi_fence"))
    w = j.groupBy(*by).agg(
        F.min(F.when(inside, _d(v))).alias("lo_whisker"), F.max(F.when(inside, _d(v))).alias("hi_whisker"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("bigint").alias("n_outliers"),
    )
    stats = q.join(w, list(by)).select(*by, "n", "q25", "q50", "q75", "iqr", "lo_whisker", "hi_whisker", "n_outliers")
    outliers = j.where(~inside)
    return stats, outliers


def pivot_mean(df: DataFrame, by: Sequence[str], row: str, col: str, values: Sequence, v: str) -> DataFrame:
    """Mean of v in a (row x col) grid per group, with explicit pivot values (no extra job to
    discover them); columns named ``{col}{value}``."""
    p = df.groupBy(*by, row).pivot(col, list(values)).agg(F.avg(_d(v)))
    return p.select(*by, row, *[F.col(str(x)).alias(f"{col}{x}") for x in values])


def fit_lines(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Per-group simple regression y ~ x: n, slope, intercept, r2 (NULL for constant x)."""
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(_d(x), _d(y)).alias("cxy"), F.var_pop(_d(x)).alias("vx"),
        F.var_pop(_d(y)).alias("vy"), F.avg(_d(x)).alias("mx"), F.avg(_d(y)).alias("my"),
    )
    slope = F.try_divide(F.col("cxy"), F.when(F.col("vx") > 0, F.col("vx")))
    return g.select(
        *by, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.try_divide(F.col("cxy") * F.col("cxy"), F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("vx") * F.col("vy"))).alias("r2"),
    )


def hist2d(df: DataFrame, x: str, y: str, bins: int, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """Counts on a bins x bins grid over the given ranges (top edge in the last bin)."""
    def b(c, lo, hi):
        w = (hi - lo) / bins if hi > lo else 1.0
        return F.least(F.greatest(F.floor((_d(c) - F.lit(lo)) / F.lit(w)), F.lit(0)), F.lit(bins - 1)).cast("int")

    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        b(x, *x_range).alias("bx"), b(y, *y_range).alias("by")
    ).agg(F.count(F.lit(1)).alias("n"))


def data_range(df: DataFrame, c: str) -> tuple[float, float]:
    r = df.agg(F.min(_d(c)).alias("lo"), F.max(_d(c)).alias("hi")).first()
    return float(r["lo"]), float(r["hi"])


def describe_by(df: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """count / min / median / mean / max per group (medians through ``quantiles``)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        aggs += [F.min(_d(m)).alias(f"{m}_min"), F.avg(_d(m)).alias(f"{m}_mean"), F.max(_d(m)).alias(f"{m}_max")]
    out = df.groupBy(by).agg(*aggs)
    for m in metrics:
        med = quantiles(df, [by], m, (0.5,)).select(by, F.col("q50").alias(f"{m}_median"))
        out = out.join(med, by, "left")
    return out


# ----------------------------------------------------------------------------------- OLS

def dummy_levels(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct levels of a categorical column (a category list: small by nature)."""
    return [r[0] for r in df.select(col).distinct().orderBy(col).collect()]


def design(df: DataFrame, num: Sequence[str], cat: str | None, levels: list[str] | None) -> tuple[list[str], list[Column]]:
    """Column expressions of the design matrix: intercept, dummies (first level dropped), numerics."""
    names, cols = ["Intercept"], [F.lit(1.0)]
    if cat:
        for lv in (levels or [])[1:]:
            names.append(f"{cat}[T.{lv}]")
            cols.append(F.when(F.col(cat) == lv, F.lit(1.0)).otherwise(F.lit(0.0)))
    for c in num:
        names.append(c)
        cols.append(_d(c))
    return names, cols


def _t_sf(t: float, dof: float) -> float:
    """Two-sided Student-t tail probability via the regularised incomplete beta function."""
    if dof <= 0 or math.isnan(t):
        return float("nan")
    x = dof / (dof + t * t)
    return _betainc(dof / 2.0, 0.5, x)


def t_quantile(level: float, dof: float) -> float:
    """The t whose two-sided Student tail is 1 - level, by bisection."""
    if dof <= 0:
        return float("nan")
    low, high = 0.0, 1.0
    while _t_sf(high, dof) > 1 - level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_sf(mid, dof) > 1 - level else (low, mid)
    return (low + high) / 2


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(math.log(x) * a + math.log(1 - x) * b + lbeta)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _betainc(b, a, 1 - x)
    # Lentz continued fraction
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = (m * (b - m) * x) / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -((a + m) * (a + b + m) * x) / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + num / (c if abs(c) > 1e-300 else 1e-300)
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0) / a


def ols(df: DataFrame, y: str, num: Sequence[str], cat: str | None = None, order_col: str | None = None) -> dict:
    """OLS y ~ 1 + C(cat) + num. Pass 1 (distributed): counts, means and deviations. Pass 2: the
    cross products of centred and scaled columns, so that an offset or a unit costs no digits.
    Driver: the p x p system (minimum-norm solution of the raw system when rank-deficient). Pass 3
    (distributed): power sums of the residuals and, given ``order_col``, the Durbin-Watson numerator.
    The passes read one checkpoint of the columns used, so the input is evaluated once."""
    data = df.where(F.col(y).isNotNull())
    for c in num:
        data = data.where(F.col(c).isNotNull())
    ensure_checkpoint_dir(df.sparkSession)
    data = data.select(*dict.fromkeys([y, *num, *([cat] if cat else []), *([order_col] if order_col else [])])).checkpoint(eager=True)
    levels = dummy_levels(data, cat) if cat else None
    names, cols = design(data, num, cat, levels)
    p = len(names)
    xs = data.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)], _d(y).alias("y"), *( [order_col] if order_col else []))
    r = xs.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("ym"), F.stddev_pop("y").alias("ys"),
               *[f(f"x{i}").alias(f"{k}{i}") for i in range(1, p) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n = int(r["n"])
    mean = np.array([0.0] + [r[f"m{i}"] or 0.0 for i in range(1, p)])
    scale = np.array([1.0] + [r[f"s{i}"] or 0.0 for i in range(1, p)])
    ybar = r["ym"] if n else float("nan")
    sst = n * (r["ys"] or 0.0) ** 2
    full = n > 0 and bool(np.all(scale > 0))
    z = [F.lit(1.0)] + [(F.col(f"x{i}") - F.lit(float(mean[i]))) / F.lit(float(scale[i] or 1.0)) for i in range(1, p)]
    yc = F.col("y") - F.lit(float(ybar))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    s = xs.agg(*[F.sum(z[i] * z[j]).alias(f"z{i}_{j}") for i, j in pairs], *[F.sum(z[i] * yc).alias(f"zy{i}") for i in range(p)],
               *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"xx{i}_{j}") for i, j in pairs], *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"xy{i}") for i in range(p)]).first()
    xtx, ztz = np.zeros((p, p)), np.zeros((p, p))
    for i, j in pairs:
        xtx[i, j] = xtx[j, i] = s[f"xx{i}_{j}"] or 0.0
        ztz[i, j] = ztz[j, i] = s[f"z{i}_{j}"] or 0.0
    if full and int(np.linalg.matrix_rank(ztz)) == p:
        rank = p
        inv = np.linalg.inv(ztz[1:, 1:]) if p > 1 else np.zeros((0, 0))
        slope = inv @ np.array([s[f"zy{i}"] for i in range(1, p)]) / scale[1:]
        beta = np.r_[ybar - slope @ mean[1:], slope]
        cov = inv / np.outer(scale[1:], scale[1:])
        var = np.r_[1 / n + mean[1:] @ cov @ mean[1:], np.diag(cov)]
        fitted = sum(((F.col(f"x{i}") - F.lit(float(mean[i]))) * F.lit(float(beta[i])) for i in range(1, p)), F.lit(float(ybar)))
    else:
        inv = np.linalg.pinv(xtx, rcond=1e-15)
        beta = inv @ np.array([s[f"xy{i}"] or 0.0 for i in range(p)])
        rank, var = int(np.linalg.matrix_rank(xtx)), np.diag(inv)
        fitted = sum((F.col(f"x{i}") * F.lit(float(beta[i])) for i in range(p)), F.lit(0.0))
    res = xs.withColumn("e", F.col("y") - fitted)
    # pass 3: power sums of the residuals
    m = res.agg(*[F.avg(F.col("e") ** i).alias(f"m{i}") for i in (1, 2, 3, 4)]).first()
    ssr = float(n * (m["m2"] or 0.0))
    dof = n - rank
    sigma2 = ssr / dof if dof > 0 else float("nan")
    se = np.sqrt(np.maximum(var * sigma2, 0.0))
    tvals = np.divide(beta, se, out=np.full_like(beta, np.nan), where=se > 0)
    pvals = [_t_sf(abs(t), dof) for t in tvals]
    half = t_quantile(0.95, dof) * se  # 95% intervals
    k_model = rank - 1
    r2 = 1 - ssr / sst if sst > 0 else float("nan")
    adj = 1 - (1 - r2) * (n - 1) / dof if dof > 0 else float("nan")
    fstat = (r2 / k_model) / ((1 - r2) / dof) if k_model > 0 and dof > 0 and r2 < 1 else float("nan")
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1) if ssr > 0 else float("nan")
    m1, m2, m3, m4 = (m[f"m{i}"] or 0.0 for i in (1, 2, 3, 4))
    c2 = m2 - m1**2
    c3 = m3 - 3 * m1 * m2 + 2 * m1**3
    c4 = m4 - 4 * m1 * m3 + 6 * m1**2 * m2 - 3 * m1**4
    skew = c3 / c2 ** 1.5 if c2 > 0 else float("nan")
    kurt = c4 / c2 ** 2 if c2 > 0 else float("nan")
    jb = n / 6 * (skew ** 2 + (kurt - 3) ** 2 / 4) if c2 > 0 else float("nan")
    dw = float("nan")
    if order_col:
        # consecutive residual differences in the explicit order: an exact rank (no single-partition
        # window) and a join of row r with row r + 1
        ranked = exact_rank(res.select(order_col, "e"), [order_col], name="_r").select("_r", "e")
        nxt = ranked.select((F.col("_r") - 1).alias("_r"), F.col("e").alias("e2"))
        d = ranked.join(nxt, "_r").agg(F.sum((F.col("e2") - F.col("e")) ** 2).alias("num")).first()
        dw = (d["num"] or 0.0) / ssr if ssr > 0 else float("nan")
    ev = np.linalg.eigvalsh(xtx)
    cond = float(np.sqrt(ev.max() / ev.min())) if ev.min() > 0 else float("inf")
    return {
        "terms": names, "coef": beta.tolist(), "se": se.tolist(), "t": tvals.tolist(), "p": pvals, "n": n, "rank": rank,
        "low": (beta - half).tolist(), "high": (beta + half).tolist(),
        "r2": r2, "adj_r2": adj, "f": fstat, "llf": llf, "aic": -2 * llf + 2 * rank, "bic": -2 * llf + rank * math.log(n) if n else float("nan"),
        "skew": skew, "kurtosis": kurt, "jb": jb, "dw": dw, "cond": cond, "levels": levels,
    }


def coef_frame(spark, fit: dict) -> DataFrame:
    """Coefficient table as a DataFrame (one row per term: p rows) with 95% intervals."""
    cols = ("coef", "se", "t", "p", "low", "high")
    rows = [(term, *[float(fit[c][i]) for c in cols]) for i, term in enumerate(fit["terms"])]
    return spark.createDataFrame(rows, "term string, coef double, se double, t double, p double, ci_low double, ci_high double")


MIN_FIT, MIN_HULL = 5, 3  # fixed values: rows a regression report and points a frontier need
REPORT = ["n", "r2", "adj_r2", "f", "llf", "aic", "bic", "skew", "kurtosis", "jb", "dw", "cond"]


def report_frame(spark, fit: dict) -> DataFrame:
    """One row of fit statistics; no row below ``MIN_FIT`` rows."""
    rows = [[float(fit[k]) for k in REPORT]] if fit["n"] >= MIN_FIT else []
    return spark.createDataFrame(rows, ", ".join(f"{k} double" for k in REPORT))


def fitted_expr(fit: dict, cat: str | None, num: Sequence[str]) -> Column:
    expr = F.lit(float(fit["coef"][0]))
    for name, b in zip(fit["terms"][1:], fit["coef"][1:]):
        if name.startswith(f"{cat}[T."):
            lv = name[len(cat) + 3:-1]
            expr = expr + F.when(F.col(cat) == lv, F.lit(float(b))).otherwise(F.lit(0.0))
        else:
            expr = expr + F.lit(float(b)) * _d(name)
    return expr


def linear_shap(df: DataFrame, fit: dict, cat: str | None, num: Sequence[str]) -> DataFrame:
    """Exact attribution for a linear model: phi_j = beta_j * (x_j - mean x_j); contributions
    add up to prediction minus the mean prediction."""
    names, cols = design(df, num, cat, fit["levels"])
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    out = [F.lit(float(b)) * (c - F.lit(float(means[f"m{i}"]))) for i, (b, c) in enumerate(zip(fit["coef"], cols))]
    return df.select("*", *[o.alias(f"phi_{n}") for n, o in zip(names[1:], out[1:])])


# --------------------------------------------------------------------- skyline and hull


def _ranged(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)


def skyline_2d(df: DataFrame, min_col: str, max_col: str) -> DataFrame:
    """Pareto set: minimise ``min_col``, maximise ``max_col``. A row survives when its value is
    the best at its ``min_col`` level and beats every strictly smaller level. The prefix
    maximum over levels is taken in two stages over a range partitioning: inside partitions, and
    over the partitions' maxima (as many rows as partitions)."""
    levels = df.groupBy(_d(min_col).alias("lv")).agg(F.max(_d(max_col)).alias("best"))
    r = _ranged(levels, ["lv"]).withColumn("_pid", F.spark_partition_id())
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    tops = r.groupBy("_pid").agg(F.max("best").alias("_top")).withColumn("_ahead", F.max("_top").over(earlier)).drop("_top")
    inside = Window.partitionBy("_pid").orderBy("lv").rowsBetween(Window.unboundedPreceding, -1)
    lv = r.withColumn("_in", F.max("best").over(inside)).join(F.broadcast(tops), "_pid")
    lv = lv.select("lv", "best", F.greatest("_in", "_ahead").alias("before"))
    j = df.join(broadcast_if_small(lv), _d(min_col) == F.col("lv"))
    keep = (_d(max_col) == F.col("best")) & (F.col("before").isNull() | (_d(max_col) > F.col("before")))
    return j.where(keep).drop("lv", "best", "before")


def _chain(points: np.ndarray) -> np.ndarray:
    """Monotone-chain convex hull (counter-clockwise, no collinear points)."""
    pts = np.unique(points, axis=0)
    if len(pts) <= 2:
        return pts

    def cross(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    lower, upper = [], []
    for p in pts:
        while len(lower) >= 2 and cross(lower[-2], lower[-1], p) <= 0:
            lower.pop()
        lower.append(tuple(p))
    for p in pts[::-1]:
        while len(upper) >= 2 and cross(upper[-2], upper[-1], p) <= 0:
            upper.pop()
        upper.append(tuple(p))
    return np.array(lower[:-1] + upper[:-1])


def hull(df: DataFrame, x: str, y: str) -> DataFrame:
    """Convex-hull vertices of (x, y), sorted by x. Every partition reduces its rows to its own
    hull (mapInPandas); only those vertices are merged in a final single task - the global
    hull is a subset of the union of local hulls. Fewer than ``MIN_HULL`` rows: no frontier."""
    pts = df.select(_d(x).alias("x"), _d(y).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())

    def local(it):
        best, rows = np.empty((0, 2)), 0
        for pdf in it:  # a batch at a time: only hull vertices stay
            best, rows = _chain(np.vstack([best, pdf[["x", "y"]].to_numpy()])), rows + len(pdf)
        yield pd.DataFrame(best, columns=["x", "y"]).assign(rows=[rows] + [0] * (len(best) - 1) if len(best) else [])

    survivors = pts.mapInPandas(local, "x double, y double, rows long")

    def final(it):
        best, rows = np.empty((0, 2)), 0
        for pdf in it:
            best, rows = _chain(np.vstack([best, pdf[["x", "y"]].to_numpy()])), rows + int(pdf["rows"].sum())
        if rows >= MIN_HULL:
            yield pd.DataFrame(best, columns=["x", "y"]).sort_values(["x", "y"])

    return survivors.repartition(1).mapInPandas(final, "x double, y double")


def shapley_permutation(df: DataFrame, model, features: Sequence[str], key: str, n_perm: int = 8, seed: int = 42) -> DataFrame:
    """Permutation Shapley values of a fitted Spark ML regressor against a single reference
    point (the feature means). For each row and each of ``n_perm`` keyed permutations the
    features are switched from the reference to the row's values one at a time; each switch's
    change in prediction is credited to that feature. Every row fans out to a fixed
    n_perm x (d + 1) points (no cross join), all scored by ``model.transform``; per row the
    contributions add up exactly to prediction - base. Returns (key, feature, phi, pred, base)."""
    from pyspark.ml.feature import VectorAssembler

    from corpuslab.functions.hashing import draw

    d = len(features)
    means = df.agg(*[F.avg(_d(f)).alias(f) for f in features]).first()
    ref = [float(means[f] or 0.0) for f in features]
    x = df.select(key, *[F.coalesce(_d(f), F.lit(0.0)).alias(f) for f in features])
    # permutation m orders the features by their keyed draws (ties by feature index); the
    # position of feature i is its index in that order - one md5 per (row, m, feature)
    orders = [
        F.transform(F.array_sort(F.array(*[F.struct(draw(seed, key, F.lit(m), F.lit(f)).alias("u"), F.lit(i).alias("i"))
                                          for i, f in enumerate(features)])), lambda s_: s_["i"]).alias(f"_o{m}")
        for m in range(n_perm)
    ]
    xo = x.select("*", *orders)
    pos_cols = [(F.array_position(F.col(f"_o{m}"), i) - 1).cast("int").alias(f"_p{m}_{i}") for m in range(n_perm) for i in range(d)]
    xp = xo.select(key, *features, *pos_cols)
    points = F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(j).alias("j"),
                 *[F.when(F.col(f"_p{m}_{i}") < j, F.col(features[i])).otherwise(F.lit(ref[i])).alias(features[i]) for i in range(d)],
                 F.array(*[F.col(f"_p{m}_{i}") for i in range(d)]).alias("perm_pos"))
        for m in range(n_perm) for j in range(d + 1)
    ])
    long = xp.select(key, F.explode(points).alias("pt")).select(key, "pt.*")
    scored = model.transform(VectorAssembler(inputCols=list(features), outputCol="features").transform(long))
    w = Window.partitionBy(key, "m").orderBy("j")  # group = one row and permutation: d + 1 rows
    steps = scored.withColumn("delta", F.col("prediction") - F.lag("prediction").over(w)).where(F.col("j") > 0)
    # the feature switched at step j is the one at position j - 1 of permutation m
    feat_idx = F.array_position(F.col("perm_pos"), F.col("j") - 1) - 1
    credited = steps.select(key, "m", F.element_at(F.array(*[F.lit(f) for f in features]), feat_idx.cast("int") + 1).alias("feature"), "delta")
    phi = credited.groupBy(key, "feature").agg((F.sum("delta") / F.lit(float(n_perm))).alias("phi"))
    ends = scored.groupBy(key).agg(
        F.max(F.when(F.col("j") == d, F.col("prediction"))).alias("pred"), F.max(F.when(F.col("j") == 0, F.col("prediction"))).alias("base")
    )
    return phi.join(ends, key)


# ------------------------------------------------------------------ exact attribution of trees


def _leaves(node, path=()):
    """(path, prediction) of every leaf; a path is a tuple of (feature, threshold, went left)."""
    if node.subtreeDepth() == 0:
        yield path, float(node.prediction())
        return
    split = node.split()
    step = (int(split.featureIndex()), float(split.threshold()))
    yield from _leaves(node.leftChild(), path + ((*step, True),))
    yield from _leaves(node.rightChild(), path + ((*step, False),))


def path_credits(shares: Sequence[float]) -> list[list[float]]:
    """Shapley values of one leaf of value 1 whose path tests m features. ``shares[j]`` is the part of the
    training rows that feature j's tests let through; entry [pattern][j] credits feature j when bit i of
    the pattern says whether feature i's tests hold for the row. Each subset of the other features that may
    be known weighs |S|! (m - |S| - 1)! / m!; a feature that is not known passes by its share."""
    m = len(shares)
    out = []
    for pattern in range(1 << m):
        holds = [pattern >> i & 1 for i in range(m)]
        row = []
        for j in range(m):
            others = [i for i in range(m) if i != j]
            total = 0.0
            for size in range(m):
                weight = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                for known in combinations(others, size):
                    total += weight * math.prod(holds[i] if i in known else shares[i] for i in others)
            row.append((holds[j] - shares[j]) * total)
        out.append(row)
    return out


def tree_attribution(df: DataFrame, model, features: Sequence[str], key: str) -> DataFrame:
    """Exact path-dependent Shapley values of a fitted tree ensemble of numeric splits (Spark ML regressor)
    for every row: (key, feature, phi, pred, base); per row the phi add up to pred - base, and base is the
    mean prediction by the trees' shares of ``df``'s rows. A leaf's value splits among the features on its
    path by ``path_credits``, computed once per leaf on the driver (as many numbers as the model has
    leaves x 2^depth); rows look their pattern up in one SQL expression, without Python. Null features
    count as zero."""
    ensure_checkpoint_dir(df.sparkSession)
    x = df.select(key, *[F.coalesce(_d(f), F.lit(0.0)).alias(f"_x{i}") for i, f in enumerate(features)]).checkpoint(eager=True)
    trees, weights = (model.trees, model.treeWeights) if hasattr(model, "trees") else ([model], [1.0])
    leaves = [(t, path, w * value) for t, (tree, w) in enumerate(zip(trees, weights)) for path, value in _leaves(tree._call_java("rootNode"))]

    def holds(steps) -> str:
        return " AND ".join(f"_x{f} {'<=' if left else '>'} {th!r}D" for f, th, left in steps) or "true"

    counts = x.agg(*[F.expr(f"count_if({holds(path)})").alias(f"c{i}") for i, (_, path, _) in enumerate(leaves)]).first()
    cover: dict[tuple, int] = {}
    for i, (t, path, _) in enumerate(leaves):
        for end in range(len(path) + 1):
            cover[t, path[:end]] = cover.get((t, path[:end]), 0) + int(counts[i])
    base, patterns, preds = 0.0, [], []
    credit: list[list[str]] = [[] for _ in features]
    for i, (t, path, value) in enumerate(leaves):
        tested = sorted({f for f, _, _ in path})
        shares = [1.0] * len(tested)
        for end, (f, _, _) in enumerate(path):
            above = cover[t, path[:end]]
            shares[tested.index(f)] *= cover[t, path[: end + 1]] / above if above else 0.0
        base += value * math.prod(shares)
        bits = [f"if({holds([s for s in path if s[0] == f])}, {1 << j}, 0)" for j, f in enumerate(tested)]
        patterns.append(" + ".join(bits) or "0")
        preds.append(f"if(_p[{i}] = {(1 << len(tested)) - 1}, {value!r}D, 0D)")
        table = path_credits(shares)
        for j, f in enumerate(tested):
            credit[f].append(f"array({', '.join(f'{value * row[j]!r}D' for row in table)})[_p[{i}]]")

    def total(terms: list[str]) -> str:
        return f"aggregate(array({', '.join(terms)}), 0D, (a, b) -> a + b)" if terms else "0D"

    rows = x.select(key, F.expr(f"array({', '.join(patterns)})").alias("_p"))
    phi = F.array(*[F.struct(F.lit(name).alias("feature"), F.expr(total(terms)).alias("phi")) for name, terms in zip(features, credit)])
    out = rows.select(key, F.expr(total(preds)).alias("pred"), F.lit(base).alias("base"), F.explode(phi).alias("_f"))
    return out.select(key, "_f.feature", "_f.phi", "pred", "base")

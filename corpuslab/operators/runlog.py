"""Run-log analytics: epoch roll-ups, norms, partial losses, schedules, triggers, merges.

The ordered fold of the plateau schedule is written as SQL higher-order functions
over the per-key ordered list: ``aggregate(array_sort(collect_list(struct(order, value))), ...)``.
They run JVM-side; the list per key is bounded by epochs (plateau). The interval trigger, whose
histories have no bound, follows ranked rows by pointer doubling instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import scalars as sc
from corpuslab.operators.ranking import broadcast_if_small, exact_rank


def epoch_metrics(steps: DataFrame) -> DataFrame:
    """Epoch train loss = mean of step losses; validation loss = mean of validation steps."""
    train = F.col("split") == "train"
    return steps.groupBy("run", "epoch").agg(
        F.avg(F.when(train, F.col("loss"))).alias("avg_loss"),
        F.avg(F.when(~train, F.col("loss"))).alias("val_loss"),
        F.exp(F.avg(F.when(train, F.col("loss")))).alias("perplexity"),
    )


def val_loss_batches(steps: DataFrame, batch: int) -> DataFrame:
    """Validation loss as the mean of batch means (reference) and as the token-weighted mean."""
    v = steps.where(F.col("split") == "val").withColumn("batch", F.floor((F.col("step") - 1) / batch))
    per_batch = v.groupBy("run", "epoch", "batch").agg(F.avg("loss").alias("b_mean"), F.count(F.lit(1)).alias("b_n"))
    return per_batch.groupBy("run", "epoch").agg(
        F.avg("b_mean").alias("val_loss_batch_mean"),
        (F.sum(F.col("b_mean") * F.col("b_n")) / F.sum("b_n")).alias("val_loss_token_mean"),
        F.count(F.lit(1)).alias("n_batches"),
    )


def global_norm(long_df: DataFrame, by: Sequence[str], vec: str) -> DataFrame:
    """sqrt(sum of squared elements over every vector of the group) and max |element|."""
    sq = F.aggregate(F.col(vec), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    mx = F.array_max(F.transform(F.col(vec), lambda x: F.abs(x.cast("double"))))
    return long_df.groupBy(*by).agg(F.sqrt(F.sum(sq)).alias("global_norm"), F.max(mx).alias("max_abs"))


CLIP_EPS = 1e-6  # fixed value


def clip_scale(norm: Column, max_norm: float = 1.0, eps: float = CLIP_EPS) -> Column:
    """Clip-by-global-norm factor: min(1, max_norm / (norm + eps))."""
    return F.least(F.lit(1.0), F.lit(max_norm) / (norm + F.lit(eps)))


def step_statistics(steps: DataFrame, norm: str, max_norm: float, order: Sequence[str], keys: Sequence[str] = ("run", "epoch")) -> DataFrame:
    """Gradient norms of an epoch's steps: mean before and after clipping to ``max_norm``, the clipped norm of the last
    step by ``order`` (a maximum, not a rank), the largest norm and the number of steps. Null norms count for nothing."""
    raw = F.col(norm).cast("double")
    known = steps.where(raw.isNotNull())
    clipped = raw * clip_scale(raw, max_norm)
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps"), F.avg(raw).alias("grad_norm_preclip"), F.avg(clipped).alias("grad_norm_postclip"),
        F.max_by(clipped, F.struct(*order)).alias("grad_norm"), F.max(raw).alias("max_grad_norm"))


def last_epoch(run_epochs: DataFrame, cols: Sequence[str]) -> DataFrame:
    return run_epochs.groupBy("run").agg(F.max_by(F.struct("epoch", *cols), F.col("epoch")).alias("l")).select("run", "l.*")


def partial_loss(steps: DataFrame, every: int) -> DataFrame:
    """Average of every full bucket of ``every`` train steps inside (run, epoch); the
    remainder of an epoch is dropped (reset at epoch start)."""
    t = steps.where(F.col("split") == "train").withColumn("bucket", F.floor((F.col("step") - 1) / every).cast("bigint"))
    return (
        t.groupBy("run", "epoch", "bucket")
        .agg(F.avg("loss").alias("partial_loss"), F.count(F.lit(1)).alias("n"), F.max("step").alias("last_step"))
        .where(F.col("n") == every)
        .drop("n")
    )


def global_step(steps: DataFrame) -> DataFrame:
    """Step counter across epochs, per run, in (epoch, step) order (skew-safe exact rank)."""
    t = steps.where(F.col("split") == "train")
    return exact_rank(t, ["epoch", "step"], partition_by=("run",), name="global_step")


def metric_curves(run_epochs: DataFrame) -> DataFrame:
    """Ordered curves per run: train/val gap and epoch-over-epoch change (rows per run = epochs)."""
    w = Window.partitionBy("run").orderBy("epoch")
    return run_epochs.select(
        "run", "epoch", "avg_loss", "val_loss",
        (F.col("val_loss") - F.col("avg_loss")).alias("gap"),
        (F.col("avg_loss") - F.lag("avg_loss").over(w)).alias("d_avg_loss"),
        (F.col("val_loss") - F.lag("val_loss").over(w)).alias("d_val_loss"),
    )


def plateau_lr(run_epochs: DataFrame, lr0: Column, loss: str = "avg_loss", factor: float = 0.25, patience: int = 1,
               threshold: float = 1e-4) -> DataFrame:
    """Reduce-on-plateau schedule (mode min, relative threshold, cooldown 0) folded over the
    epochs of each run; the logged rate of an epoch is the one in force before its update."""
    per_run = run_epochs.groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("epoch", F.col(loss).alias("loss")))).alias("h"), F.first(lr0).alias("lr0")
    )
    init = F.struct(
        F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.col("lr0").cast("double").alias("lr"),
        F.array().cast("array<struct<epoch:int,lr:double>>").alias("out"),
    )

    def step(acc, x):
        better = x["loss"] < acc["best"] * F.lit(1.0 - threshold)
        best = F.when(better, x["loss"]).otherwise(acc["best"])
        bad = F.when(better, F.lit(0)).otherwise(acc["bad"] + 1)
        cut = bad > patience
        new_lr = F.when(cut, acc["lr"] * F.lit(factor)).otherwise(acc["lr"])
        logged = F.array_append(acc["out"], F.struct(x["epoch"].cast("int").alias("epoch"), acc["lr"].alias("lr")))
        return F.struct(best.alias("best"), F.when(cut, F.lit(0)).otherwise(bad).alias("bad"), new_lr.alias("lr"), logged.alias("out"))

    folded = per_run.select("run", F.aggregate("h", init, step)["out"].alias("out"))
    return folded.select("run", F.explode("out").alias("o")).select("run", "o.epoch", "o.lr")


def interval_trigger(events: DataFrame, key: str, t_col: Column, interval: int) -> DataFrame:
    """Re-arming trigger: fire when t >= next, then next = t + interval (drifts with the
    firing time, unlike a tumbling window). Times are integers (e.g. microseconds). Returns the
    firing rows (key, t, event_id).

    No per-key list is gathered. With rows ranked per key by (t, event_id), the
    firing rows are the chain 1, nxt(1), nxt(nxt(1)), ... where nxt(r) is the first row with
    t >= t_r + interval. nxt comes from one skew-safe rank over the union of rows and probes
    (t_r + interval): a probe at position pos for source rank s has pos - s rows before it.
    The chain is then followed by pointer doubling: log2(rows per key) rounds of joins on
    (key, rank), each checkpointed; rows of a hot key spread over partitions by rank."""
    ev = events.select(key, t_col.cast("bigint").alias("t"), "event_id")
    r = exact_rank(ev, ["t", "event_id"], partition_by=(key,), name="r")
    probes = r.select(key, (F.col("t") + F.lit(interval)).alias("t"), F.lit(0).alias("kind"), F.col("r").alias("tb"), F.col("r").alias("src"))
    rows = r.select(key, "t", F.lit(1).alias("kind"), F.col("r").alias("tb"), F.lit(None).cast("bigint").alias("src"))
    pos = exact_rank(probes.unionByName(rows), ["t", "kind", "tb"], partition_by=(key,), name="pos")
    n_key = r.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    nxt = pos.where(F.col("kind") == 0).select(key, F.col("src").alias("r"), (F.col("pos") - F.col("src") + 1).alias("nxt"))
    jump = nxt.join(n_key, key).select(key, "r", F.when(F.col("nxt") <= F.col("n"), F.col("nxt")).alias("j")).checkpoint(eager=True)
    chain = r.where(F.col("r") == 1).select(key, "r").checkpoint(eager=True)
    while True:
        step = chain.join(jump, [key, "r"]).where(F.col("j").isNotNull()).select(key, F.col("j").alias("r"))
        new = step.join(chain, [key, "r"], "left_anti").checkpoint(eager=True)
        if new.isEmpty():
            break
        chain = chain.unionByName(new).checkpoint(eager=True)
        j2 = jump.alias("a").join(jump.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.j") == F.col("b.r")), "left")
        jump = j2.select(F.col(f"a.{key}").alias(key), F.col("a.r").alias("r"), F.col("b.j").alias("j")).checkpoint(eager=True)
    return chain.join(r, [key, "r"]).select(key, "t", "event_id")


def merge_last_wins(df: DataFrame, key: str, seq: str, cols: Sequence[str]) -> DataFrame:
    """De-duplicate by key: values of the row with the largest seq win; ``first_seq`` keeps the
    first-seen order. Pure aggregation (partial aggregation absorbs hot keys)."""
    return df.groupBy(key).agg(
        F.max_by(F.struct(*cols), F.col(seq)).alias("w"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq")
    ).select(key, "first_seq", "last_seq", "w.*")


def merge_override(left: DataFrame, right: DataFrame, key: str, null_overrides: bool = False, how: str = "inner") -> DataFrame:
    """Join (inner, or left to keep rows without a partner); for shared columns the right side wins (``coalesce(right, left)``, or the
    right value even when NULL if ``null_overrides``); columns of either side are kept."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    l_ = left.alias("l")
    r_ = right.alias("r")
    j = l_.join(r_, key, how)
    cols = [F.col(key)]
    for c in left.columns:
        if c == key:
            continue
        if c in shared:
            cols.append((F.col(f"r.{c}") if null_overrides else F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}"))).alias(c))
        else:
            cols.append(F.col(f"l.{c}"))
    cols += [F.col(f"r.{c}") for c in right.columns if c != key and c not in shared]
    return j.select(*cols)


def parse_runs(names: DataFrame, name_col: str = "config_name", lenient: bool = False, overrides=None, keep: Sequence[str] = ()):
    """(accepted, rejected): accepted rows carry typed configuration columns; rejected rows
    carry the ``keep`` columns and the comma list of missing keys."""
    # parsed once and materialised: both outputs read it, and the completeness filter does not
    # re-evaluate the eleven regular expressions
    parsed = names.select("*", *sc.parse_config(F.col(name_col), lenient, overrides)).persist(StorageLevel.MEMORY_AND_DISK)
    complete = F.lit(True)
    for k in sc.CONFIG_KEYS:
        complete = complete & F.col(k).isNotNull()
    ok = parsed.where(complete)
    bad = parsed.where(~complete).select(*keep, name_col, sc.missing_keys().alias("missing"))
    return ok, bad


def summarize_runs(names: DataFrame, epochs: DataFrame, name_col: str = "config_name") -> tuple[DataFrame, DataFrame]:
    """(summary, rejects) of runs given by name: the configuration is parsed from the name, the metrics of the
    run's last epoch are laid over it (a metric wins over a configuration value of the same name unless it
    is null), a run without epochs keeps its configuration. A name that does not parse goes to the rejects with
    its run and the missing keys and touches no other run. ``names``: run and name; ``epochs``: run, epoch, metrics."""
    ok, bad = parse_runs(names, name_col, keep=("run",))
    last = last_epoch(epochs, [c for c in epochs.columns if c not in ("run", "epoch")])
    return merge_override(ok, last, "run", how="left"), bad


def skip_existing(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Left-anti on the key. The done-set is a key list: broadcast when small."""
    return planned.join(broadcast_if_small(done.select(key).distinct()), key, "left_anti")


def dedup_columns(df: DataFrame) -> DataFrame:
    """Drop repeated column names, first occurrence wins (schema-level, no data movement)."""
    seen, keep = set(), []
    for i, name in enumerate(df.columns):
        if name not in seen:
            seen.add(name)
            keep.append(i)
    renamed = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"_c{i}").alias(df.columns[i]) for i in keep])

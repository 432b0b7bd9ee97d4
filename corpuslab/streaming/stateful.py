"""Structured Streaming versions of the run-log state machines.

Each operator keeps O(1) state per key in the state store (``applyInPandasWithState``), so a
key with unbounded history never has to be collected into one list. Keys are dealt by a hash into
``buckets``, and the store holds one row a bucket: the state of all its keys, as packed arrays. A call
of the Python operator costs milliseconds, whatever it brings, and most keys bring a few rows a
micro-batch, so a call takes a bucket's rows and not a key's. Rows of one micro-batch
are ordered inside the processor by (ts, event_id); order *across* micro-batches is the
source's duty (files arrive in time order). A row older than its key's last processed row is
reported as ``late`` and never enters the state.

All jobs run with ``trigger(availableNow=True)`` into sinks under the shared checkpoint folder,
with a checkpoint location there too, so a restarted job resumes from its last commit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuslab.functions import scalars as sc
from corpuslab.operators import runlog as rl
from corpuslab.operators.ranking import broadcast_if_small


# ----------------------------------------------------------------------- X1 partial loss

PARTIAL_OUT = "run long, epoch int, kind string, event_id long, bucket long, partial_loss double, last_step long"
PARTIAL_STATE = "run binary, slot binary, n binary, s binary, last_ts binary, last_id binary"
BUCKETS = 512
_NONE = 2**63 - 1  # a null time or event id: after all others
_BEFORE = -(2**62)  # earlier than any time


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in arrays sorted together."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _bucket_state(state: GroupState, types: str, initial: list, key: np.ndarray, slot: np.ndarray):
    """(keys, fields, number): every key that the bucket's state or its new rows (key, slot) hold, once; the fields
    of its state, ``initial`` for a new key; and the place of each new row's key among them."""
    held = [np.frombuffer(x, t) for x, t in zip(state.get, types)] if state.exists else [np.zeros(0, t) for t in types]
    known = len(held[0])
    both = [np.r_[held[0], key], np.r_[held[1], slot]]
    order = np.lexsort(both[::-1])
    head = _starts(both[0][order], both[1][order])
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(order)]))
    fields = []
    for old, value in zip(held[2:], initial):
        field = np.full(len(head), value, old.dtype)
        field[number[:known]] = old
        fields.append(field)
    return [k[order][head] for k in both], fields, number[known:]


def _in_order(number: np.ndarray, ts: np.ndarray, eid: np.ndarray, last_ts: np.ndarray, last_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new rows in (key, ts, event_id) order, late rows): late is what is not after the last row of its key, or repeats a row.
    The last rows of the keys move on."""
    order = np.lexsort((eid, ts, number))
    k, t, e = number[order], ts[order], eid[order]
    late = (t < last_ts[k]) | ((t == last_ts[k]) & (e <= last_id[k]))
    late[1:] |= (k[1:] == k[:-1]) & (t[1:] == t[:-1]) & (e[1:] == e[:-1])
    new = order[~late]
    ends = _starts(number[new][::-1])  # the last row of each key, from behind
    tail = new[::-1][ends]
    last_ts[number[tail]], last_id[number[tail]] = ts[tail], eid[tail]
    return new, order[late]


def _or_null(values: np.ndarray, null: np.ndarray) -> pd.Series:
    return pd.Series(pd.arrays.IntegerArray(values.astype(np.int64), np.asarray(null, bool)))


def _nulls(n: int) -> pd.Series:
    return _or_null(np.zeros(n), np.ones(n))


def _partial_fn(every: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pdfs))
        run, slot, ts, eid, loss = (rows[c].to_numpy() for c in ("run", "slot", "ts_us", "event_id", "loss"))
        keys, (n, s, last_ts, last_id), number = _bucket_state(state, "qqqdqq", [0, 0.0, _BEFORE, -1], run, slot)
        new, late = _in_order(number, ts, eid, last_ts, last_id)

        def named(at):
            return {"run": _or_null(keys[0][at], keys[1][at] & 2), "epoch": _or_null(keys[1][at] >> 2, keys[1][at] & 1)}

        if len(new):
            k = number[new]
            first = _starts(k)
            size = np.diff(np.r_[first, len(k)])
            bucket = (np.repeat(n[k[first]] - first, size) + np.arange(len(k))) // every
            starts = _starts(k, bucket)
            sums = np.add.reduceat(loss[new].astype(np.float64), starts)
            k, bucket = k[starts], bucket[starts]
            head = _starts(k)
            tail = np.r_[head[1:], len(k)] - 1
            sums[head] += s[k[head]]  # the open buckets of earlier batches
            n[k[head]] += size
            full = (bucket + 1) * every <= n[k]
            s[k[tail]] = np.where(full[tail], 0.0, sums[tail])
            done = bucket[full]
            yield pd.DataFrame({**named(k[full]), "kind": "bucket", "event_id": _nulls(len(done)), "bucket": done,
                                "partial_loss": sums[full] / every, "last_step": (done + 1) * every})
        state.update(tuple(x.tobytes() for x in (*keys, n, s, last_ts, last_id)))
        if len(late):
            none = _nulls(len(late))
            yield pd.DataFrame({**named(number[late]), "kind": "late", "event_id": _or_null(eid[late], eid[late] == _NONE), "bucket": none,
                                "partial_loss": np.nan, "last_step": none})

    return fn


def _zero(c: str):
    return F.coalesce(F.col(c).cast("long"), F.lit(0))


def _times() -> list:
    """Time and event id of a row as numbers that are never null."""
    ts = F.unix_micros(sc.utc_instant("ts"))
    return [F.coalesce(F.col("event_id").cast("long"), F.lit(_NONE)).alias("event_id"), F.coalesce(ts, F.lit(_NONE)).alias("ts_us")]


def partial_loss_stream(steps: DataFrame, every: int, buckets: int = BUCKETS) -> DataFrame:
    """Average of each full bucket of ``every`` training steps per (run, epoch) as rows of kind 'bucket'; a step
    that comes after a later one of its key is a row of kind 'late' with its event id. A key's slot is its epoch with two
    bits for a null run and a null epoch; the number of state buckets is fixed for a checkpoint."""
    slot = _zero("epoch") * 4 + F.when(F.col("run").isNull(), 2).otherwise(0) + F.when(F.col("epoch").isNull(), 1).otherwise(0)
    s = steps.where(F.col("split") == "train").select(
        F.pmod(F.xxhash64("run", "epoch"), F.lit(buckets)).alias("part"), _zero("run").alias("run"), slot.cast("long").alias("slot"), "loss", *_times()
    )
    return s.groupBy("part").applyInPandasWithState(
        _partial_fn(every), PARTIAL_OUT, PARTIAL_STATE, "append", GroupStateTimeout.NoTimeout
    )


# -------------------------------------------------------------------- X2 interval trigger

TRIGGER_OUT = "user_id long, event_id long, kind string"
TRIGGER_STATE = "user binary, slot binary, nxt binary, last_ts binary, last_id binary"


def _trigger_fn(interval_us: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pdfs))
        user, slot, ts, eid = (rows[c].to_numpy() for c in ("user", "slot", "ts_us", "event_id"))
        keys, (nxt, last_ts, last_id), number = _bucket_state(state, "qqqqq", [_BEFORE, _BEFORE, -1], user, slot)
        timed = np.flatnonzero(ts != _NONE)
        new, late = (timed[x] for x in _in_order(number[timed], ts[timed], eid[timed], last_ts, last_id))
        late = np.r_[late, np.flatnonzero(ts == _NONE)]  # a row without a time has no place in the order
        first, times, fired = _starts(number[new]), ts[new], []
        for at, end in zip(first, np.r_[first[1:], len(new)]):
            k = number[new[at]]
            while at < end:  # from one firing to the next
                at += int(np.searchsorted(times[at:end], nxt[k]))
                if at < end:
                    fired.append(at)
                    nxt[k] = times[at] + interval_us
        out = np.r_[new[np.array(fired, np.int64)], late]
        state.update(tuple(x.tobytes() for x in (*keys, nxt, last_ts, last_id)))
        yield pd.DataFrame({"user_id": _or_null(user[out], slot[out]), "event_id": _or_null(eid[out], eid[out] == _NONE),
                            "kind": np.repeat(np.array(["fire", "late"], object), [len(fired), len(late)])})

    return fn


def interval_trigger_stream(events: DataFrame, interval_us: int, buckets: int = BUCKETS) -> DataFrame:
    e = events.select(F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("part"), _zero("user_id").alias("user"),
                      F.col("user_id").isNull().cast("long").alias("slot"), *_times())
    return e.groupBy("part").applyInPandasWithState(
        _trigger_fn(interval_us), TRIGGER_OUT, TRIGGER_STATE, "append", GroupStateTimeout.NoTimeout
    )


# --------------------------------------------------------------------- X3 plateau schedule

PLATEAU_OUT = "run long, epoch int, kind string, lr double"
PLATEAU_STATE = "run binary, slot binary, best binary, bad binary, lr binary, last_epoch binary"


def _plateau_fn(factor: float, patience: int, threshold: float):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pdfs))
        run, slot, epochs, losses, lr0 = (rows[c].to_numpy() for c in ("run", "slot", "epoch", "loss", "lr0"))
        keys, (best, bad, lr, last_epoch), number = _bucket_state(state, "qqdqdq", [np.inf, 0, np.nan, _BEFORE], run, slot)
        rates, late = np.zeros(len(rows)), np.zeros(len(rows), bool)
        for i in np.lexsort((epochs, number)):
            k, epoch, loss = number[i], epochs[i], losses[i]
            if last_epoch[k] == _BEFORE:
                lr[k], last_epoch[k] = lr0[i], -1
            if epoch <= last_epoch[k]:
                late[i] = True
                continue
            rates[i] = lr[k]
            better = loss < best[k] * (1.0 - threshold)  # never for a missing loss
            if better:
                best[k], bad[k] = loss, 0
            else:
                bad[k] += 1
            if bad[k] > patience:
                lr[k], bad[k] = lr[k] * factor, 0
            last_epoch[k] = epoch
        state.update(tuple(x.tobytes() for x in (*keys, best, bad, lr, last_epoch)))
        yield pd.DataFrame({"run": _or_null(run, slot), "epoch": epochs, "kind": np.where(late, "late", "rate").astype(object), "lr": np.where(late, np.nan, rates)})

    return fn


def plateau_lr_stream(epochs: DataFrame, factor: float = 0.25, patience: int = 1, threshold: float = 1e-4, buckets: int = BUCKETS) -> DataFrame:
    """Learning rate of every epoch (run, epoch, loss, lr0) as rows of kind 'rate'; an epoch that comes after a
    later or equal one of its run is a row of kind 'late' and leaves the schedule as it is."""
    e = epochs.select(F.pmod(F.xxhash64("run"), F.lit(buckets)).alias("part"), _zero("run").alias("run"), F.col("run").isNull().cast("long").alias("slot"),
                      "epoch", F.col("loss").cast("double").alias("loss"), F.col("lr0").cast("double").alias("lr0"))
    return e.groupBy("part").applyInPandasWithState(
        _plateau_fn(factor, patience, threshold), PLATEAU_OUT, PLATEAU_STATE, "append", GroupStateTimeout.NoTimeout
    )


# -------------------------------------------------------------- X5 windowed epoch metrics


def epoch_metrics_stream(steps: DataFrame, window: str = "6 days", watermark: str = "1 day") -> DataFrame:
    """Running mean train loss per (run, tumbling window of event time). The watermark bounds
    the state: windows older than the watermark are finalised and dropped."""
    s = steps.where(F.col("split") == "train").withColumn("ets", sc.utc_instant("ts"))
    return (
        s.withWatermark("ets", watermark)
        .groupBy("run", F.window("ets", window).alias("w"))
        .agg(F.avg("loss").alias("avg_loss"), F.count(F.lit(1)).alias("n"))
        .select("run", F.col("w.start").alias("window_start"), "avg_loss", "n")
    )


# --------------------------------------------------------------- running a stream to the end


def run_to_parquet(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Run a streaming DataFrame to completion (available-now) into a Parquet folder."""
    q = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def run_upserts(df: DataFrame, sink: str, checkpoint: str, key: list[str]) -> None:
    """Update-mode stream: every micro-batch's changed rows are written under a folder named
    by its batch id (a replayed batch overwrites its own folder: idempotent); readers keep the
    latest batch per key (see ``read_upserts``)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    q = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()


def read_upserts(spark: SparkSession, sink: str, key: list[str]) -> DataFrame:
    df = spark.read.parquet(sink)
    cols = [c for c in df.columns if c not in (*key, "batch_id", "batch")]
    return df.groupBy(*key).agg(F.max_by(F.struct(*cols), "batch_id").alias("r")).select(*key, "r.*")


def summaries_stream(epoch_logs: DataFrame, sink: str, checkpoint: str, cols: list[str], known: DataFrame | None = None) -> None:
    """Incremental run summaries: each micro-batch writes the last epoch of the runs that it brings, and nothing
    else, under its batch id (a replayed batch rewrites the same folder); runs in ``known`` (column run:
    summarised before the stream) are left out. ``latest_version`` merges the deltas."""

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.select("run", "epoch", *cols)
        if known is not None:
            new = new.join(broadcast_if_small(known.select("run").distinct()), "run", "left_anti")
        merged = rl.merge_last_wins(new, "run", "epoch", ["epoch", *cols]).select("run", "epoch", *cols)
        merged.write.mode("overwrite").parquet(f"{sink}/v={batch_id}")

    q = epoch_logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest_version(spark: SparkSession, sink: str) -> DataFrame:
    """One row per run: its last epoch over all deltas; of equal epochs the newest delta wins."""
    df = spark.read.parquet(sink)
    cols = [c for c in df.columns if c not in ("run", "v")]
    return df.groupBy("run").agg(F.max_by(F.struct(*cols), F.struct("epoch", "v")).alias("r")).select("run", "r.*")

"""Exact ranks without a single-partition window, and size-checked broadcast.

``row_number() over (order by ...)`` with no partition, or partitioned by a key that may hold a
third of all rows, funnels those rows through one task. ``exact_rank`` instead

1. range-partitions on (group keys, order keys) - a hot group is spread over many partitions -
   and sorts inside partitions;
2. numbers rows inside each partition with ``monotonically_increasing_id`` (partition id in the
   upper bits, position in the lower bits) and writes them with their numbers to the shared folder, once: a
   re-sampled range partitioner could move the boundaries, and sorted columns shrink to a fraction of a checkpoint's rows;
3. counts rows per (partition, group) - at most groups + partitions rows - and turns them into
   offsets with a window over that small table;
4. joins the offsets back (broadcast when the offsets table is provably small).

The result equals ``row_number() over (partition by g order by o)`` exactly, provided the order
keys are unique inside a group (callers always add a tie-breaker).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.session import BROADCAST_MAX_BYTES, ensure_checkpoint_dir, written


def table_bytes(df: DataFrame) -> int:
    """Measured size of a table: 8 bytes a column and what its strings, arrays and structs hold."""
    wide = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            wide.append(F.octet_length(c))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
            wide.append(F.size(c) * 8)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            wide.append(F.octet_length(F.to_json(F.struct(c))))
    row = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(16 + 8 * len(df.columns)).cast("long"))
    return df.agg(F.sum(row)).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES, known_bytes: int | None = None) -> DataFrame:
    """Broadcast hint only behind a check of the measured size; otherwise leave the join to a
    shuffle (AQE may still convert it at run time, and splits skewed partitions)."""
    size = known_bytes if known_bytes is not None else table_bytes(df)
    return F.broadcast(df) if size <= max_bytes else df


def spread_join(df: DataFrame, other: DataFrame, on: str, by: str, limit: int = 50_000) -> DataFrame:
    """Inner join with a table that holds each key ``on`` once. Rows of a key that more than ``limit`` rows share are
    dealt into pieces by a hash of ``by``, and meet a copy of the key's row each, so that no task holds a key's rows."""
    n = F.ceil(F.count(F.lit(1)) / limit).cast("int")
    hot = F.broadcast(df.groupBy(on).agg(n.alias("_n")).where("_n > 1"))  # at most a row for each ``limit`` rows
    left = df.join(hot, on, "left").withColumn("_p", F.pmod(F.xxhash64(by), F.coalesce("_n", F.lit(1))).cast("int"))
    right = other.join(hot, on, "left").withColumn("_p", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)))
    return left.drop("_n").join(right.drop("_n"), [on, "_p"]).drop("_p")


def _sort_expr(o) -> Column:
    return F.col(o).asc() if isinstance(o, str) else o


def exact_rank(
    df: DataFrame,
    order_by: Sequence,
    partition_by: Sequence[str] = (),
    name: str = "rank",
    num_partitions: int | None = None,
) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = list(partition_by)
    sort_exprs = [F.col(c).asc() for c in parts] + [_sort_expr(o) for o in order_by]
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *sort_exprs).sortWithinPartitions(*sort_exprs)
    x = written(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    x = x.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_idx", F.col("_mid") - F.shiftleft(F.col("_pid"), 33)
    )
    counts = x.groupBy("_pid", *parts).agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    w = (Window.partitionBy(*parts) if parts else Window).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    renamed = offsets.select(
        F.col("_pid").alias("_o_pid"),
        *[F.col(c).alias(f"_o_{c}") for c in parts],
        "_off",
        "_first",
    )
    if parts:
        renamed = broadcast_if_small(renamed)
    else:  # at most num_partitions rows: bounded by construction
        renamed = F.broadcast(renamed)
    cond = [x["_pid"] == renamed["_o_pid"]] + [x[c].eqNullSafe(renamed[f"_o_{c}"]) for c in parts]
    joined = x.join(renamed, cond, "inner")
    out = joined.withColumn(name, (F.col("_off") + F.col("_idx") - F.col("_first") + 1).cast("bigint"))
    return out.drop("_mid", "_pid", "_idx", "_o_pid", "_off", "_first", *[f"_o_{c}" for c in parts])


def running_total(df: DataFrame, order_by: Sequence, weight: str, partition_by: Sequence[str] = (), name: str = "total", before: str | None = None) -> DataFrame:
    """Inclusive running sum of ``weight`` in each group (exclusive in ``before``, if it is named), without a task that holds a group: rows are
    range-partitioned on (group, order) and frozen as in ``exact_rank``, summed inside partitions and
    shifted by what the partitions before hold of the group."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = list(partition_by)
    sort_exprs = [F.col(c).asc() for c in parts] + [_sort_expr(o) for o in order_by]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = df.repartitionByRange(n, *sort_exprs).checkpoint(eager=True).withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid", *parts).orderBy(*[_sort_expr(o) for o in order_by])
    inside = x.withColumn("_in", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if before:
        inside = inside.withColumn("_ex", F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    earlier = Window.partitionBy(*parts).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    held = x.groupBy("_pid", *parts).agg(F.sum(weight).alias("_w")).withColumn("_off", F.coalesce(F.sum("_w").over(earlier), F.lit(0)))
    out = inside.join(broadcast_if_small(held.drop("_w")), ["_pid", *parts]).withColumn(name, F.col("_in") + F.col("_off"))
    out = out.withColumn(before, F.col("_ex") + F.col("_off")) if before else out
    return out.drop("_pid", "_in", "_ex", "_off")


def rank_cut(df: DataFrame, order_by: Sequence, n_keep: int, flag: str = "in_head") -> DataFrame:
    """Flag the first ``n_keep`` rows in a total order (exact-count split), through
    ``exact_rank`` so no single-partition exchange is needed."""
    ranked = exact_rank(df, order_by, name="_r")
    return ranked.withColumn(flag, F.col("_r") <= F.lit(n_keep)).drop("_r")

"""Pareto frontier in any number of dimensions.

1. Distinct cost vectors: dominance depends on nothing else, and repeated rows are joined back at the end.
2. Every partition drops what its own rows dominate, a batch at a time; a front that outgrows ``FRONT`` rows
   is handed on as it is, so memory stays bounded.
3. The survivors are laid on a grid of at most ``CELLS`` cells (quantile cuts in each dimension). A cell
   that lies above another occupied cell in every dimension is dropped whole.
4. A remaining cell is checked against the cells that lie nowhere above it, in pieces of ``PIECE`` rows:
   one task per pair of pieces names the dominated rows, which an anti-join removes.

Nothing but the list of occupied cells (at most ``CELLS``) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.ranking import broadcast_if_small
from corpuslab.session import ensure_checkpoint_dir

CELLS = 256
FRONT = 20_000
PIECE = 20_000


def front(points: np.ndarray) -> np.ndarray:
    """The rows (distinct, to be minimised) that no other row dominates: the row of the smallest sum is never
    dominated; it removes what it dominates, and so on. One numpy step per row of the front."""
    rest = points[np.lexsort((*points.T, points.sum(axis=1)))]
    kept = []
    while len(rest):
        head = rest[0]
        kept.append(head)
        rest = rest[1:][(rest[1:] < head).any(axis=1)]
    return np.array(kept).reshape(-1, points.shape[1])


def dominated(rows: np.ndarray, by: np.ndarray, step: int = 256) -> np.ndarray:
    """Flags of the rows that some row of ``by`` dominates: nowhere above and somewhere below."""
    out = np.zeros(len(rows), bool)
    for at in range(0, len(by), step):
        b = by[at : at + step]
        open_rows = np.flatnonzero(~out)
        for lo in range(0, len(open_rows), 4096):
            part = open_rows[lo : lo + 4096]
            x = rows[part][:, None, :]
            out[part] |= ((b <= x).all(axis=2) & (b < x).any(axis=2)).any(axis=1)
    return out


def skyline(df: DataFrame, mins: Sequence[str], maxs: Sequence[str] = (), cells: int = CELLS, piece: int = PIECE) -> DataFrame:
    """Rows of ``df`` that no other row dominates, all columns kept: a row dominates another that it is nowhere worse than
    and somewhere better, ``mins`` to be small and ``maxs`` to be large. Rows that are equal in all of them
    stand or fall together. Rows with a null or NaN among them are left out; an empty table gives none."""
    ensure_checkpoint_dir(df.sparkSession)
    names = [f"_c{i}" for i in range(len(mins) + len(maxs))]
    d = len(names)
    # + 0.0: one zero, as equal keys must be
    costs = [F.col(c).cast("double") + F.lit(0.0) for c in mins] + [F.lit(0.0) - F.col(c).cast("double") for c in maxs]
    present = [c.isNotNull() & ~F.isnan(c) for c in costs]
    usable = df.select("*", *[c.alias(n) for c, n in zip(costs, names)])
    for p in present:
        usable = usable.where(p)
    schema = ", ".join(f"{n} double" for n in names)

    def local(it):
        best = np.empty((0, d))
        for pdf in it:
            for at in range(0, len(pdf), 4096):
                new = pdf[names].to_numpy()[at : at + 4096]
                new = new[~dominated(new, best)]
                best = front(np.vstack([best, new]))
                if len(best) > FRONT:
                    yield pd.DataFrame(best, columns=names)
                    best = np.empty((0, d))
        yield pd.DataFrame(best, columns=names)

    left = usable.select(*names).distinct().mapInPandas(local, schema).checkpoint(eager=True)
    side = max(1, int(cells ** (1 / d) + 1e-9))
    cuts = left.agg(*[F.percentile_approx(n, [i / side for i in range(1, side)] or [0.5], 10000).alias(n) for n in names]).first()
    # the number of cuts below the value, a digit per dimension
    steps = [sum((F.when(F.col(n) > F.lit(v), 1).otherwise(0) for v in sorted(set(cuts[n] or []))[: side - 1]), F.lit(0)) for n in names]
    cell = sum((s * side**i for i, s in enumerate(steps)), F.lit(0))
    placed = left.withColumn("_cell", cell.cast("int"))
    sizes = {r["_cell"]: r["n"] for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``cells`` rows
    at = {c: np.array([c // side**i % side for i in range(d)]) for c in sizes}
    alive = [c for c in at if not any((at[o] < at[c]).all() for o in at)]
    parts = {c: -(-sizes[c] // piece) for c in alive}
    pairs = [(b, a, parts[b], parts[a]) for a in alive for b in alive if (at[a] <= at[b]).all()]
    # of a pair of cells (row, judge): each piece of rows meets each piece of judges
    meets = F.broadcast(df.sparkSession.createDataFrame(pairs, "row int, judge int, row_parts int, judge_parts int"))  # at most cells^2 rows
    piece_of = F.xxhash64(*names)

    def dealt(side_cell: str, mine: str, mine_parts: str, other: str, other_parts: str) -> DataFrame:
        x = placed.join(meets, F.col("_cell") == F.col(side_cell)).withColumn(mine, F.pmod(piece_of, F.col(mine_parts)).cast("int"))
        return x.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1))).select(*names, "row", "judge", "rp", "jp")

    by = [f"_j{i}" for i in range(d)]

    def judge(rows: pd.DataFrame, judges: pd.DataFrame) -> pd.DataFrame:
        x = rows[names].to_numpy().reshape(-1, d)
        return pd.DataFrame(x[dominated(x, judges[by].to_numpy().reshape(-1, d))], columns=names)

    keys = ["row", "judge", "rp", "jp"]
    judges = dealt("judge", "jp", "judge_parts", "rp", "row_parts").toDF(*by, *[f"_{k}" for k in keys])
    lost = dealt("row", "rp", "row_parts", "jp", "judge_parts").groupBy(*keys).cogroup(judges.groupBy(*[f"_{k}" for k in keys])).applyInPandas(judge, schema)
    stay = placed.where(F.col("_cell").isin(alive)).join(lost, names, "left_anti").select(*names).checkpoint(eager=True)
    return usable.join(broadcast_if_small(stay), names, "left_semi").drop(*names)

"""Pluggable scorers: a model of the user's choice over rows, in Arrow batches.

A scorer names the columns it reads (``columns``), the columns it makes (``schema``, DDL) and turns a batch into
them (``score``). Two ways to run one:

* ``score_rows``: the whole model is in the scorer and goes to every task. Its pickled size is checked.
* ``score_keyed``: the model is a table as large as the corpus. Distinct keys and model rows are dealt into slices
  by a hash of the key, as many as their bytes fill, and each slice is one call; every key is scored once and
  joined back, so neither a frequent key nor a large model meets one task.

Null keys match null keys. No rows: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.operators.ranking import table_bytes

MODEL_BYTES = 64 << 20  # of a scorer sent to every task
SLICE_BYTES = 16 << 20  # of keys and model rows that meet in one task


class Scorer(Protocol):
    """``score`` gets a batch with ``columns`` (and, keyed, the model rows of the same slice) and returns as many
    rows in the same order with the columns of ``schema``."""

    columns: Sequence[str]
    schema: str

    def score(self, batch: pd.DataFrame, model: pd.DataFrame | None = None) -> pd.DataFrame: ...


def _result(rows: DataFrame, keep: Sequence[str], scorer: Scorer) -> T.StructType:
    made = T._parse_datatype_string(scorer.schema).fields
    clash = {f.name for f in made} & set(keep)
    if clash:
        raise ValueError(f"the scorer makes columns that are kept: {sorted(clash)}")
    return T.StructType([rows.schema[k] for k in keep] + made)


def _joined(batch: pd.DataFrame, keep: list[str], made: pd.DataFrame) -> pd.DataFrame:
    if len(made) != len(batch):
        raise ValueError(f"a scorer returned {len(made)} rows for {len(batch)}")
    return pd.concat([batch[keep].reset_index(drop=True), made.reset_index(drop=True)], axis=1)


def score_rows(rows: DataFrame, scorer: Scorer, keep: Sequence[str], max_bytes: int = MODEL_BYTES) -> DataFrame:
    """``keep`` and the scorer's columns for every row; a narrow step."""
    packed = cloudpickle.dumps(scorer)  # by value, also where the class is defined in a notebook
    if len(packed) > max_bytes:
        raise ValueError(f"a scorer of {len(packed)} bytes is not sent to every task; score by key from a table")
    keep, reads = list(keep), list(scorer.columns)
    schema = _result(rows, keep, scorer)
    sent = rows.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        model = cloudpickle.loads(sent.value)
        for batch in batches:
            yield _joined(batch, keep, model.score(batch[reads]))

    return rows.select(*dict.fromkeys([*keep, *reads])).mapInPandas(run, schema)


def score_keyed(rows: DataFrame, model: DataFrame, keys: Sequence[str], scorer: Scorer) -> DataFrame:
    """``rows`` with the scorer's columns, which depend on ``scorer.columns`` (the keys among them) and on the model
    rows of the same key alone."""
    reads = list(dict.fromkeys([*keys, *scorer.columns]))
    distinct = rows.select(*reads).distinct()
    schema = _result(distinct, reads, scorer)
    _result(rows, rows.columns, scorer)
    slices = max(1, math.ceil((table_bytes(distinct) + table_bytes(model)) / SLICE_BYTES))
    deal = F.pmod(F.xxhash64(*keys), F.lit(slices)).alias("_slice")
    model = model.select(*[F.col(x).alias(x) for x in model.columns])  # columns of its own, also where rows come from the same table

    def run(batch: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        return _joined(batch, reads, scorer.score(batch[reads], part.drop(columns="_slice")))

    scored = distinct.select("*", deal).groupBy("_slice").cogroup(model.select("*", deal).groupBy("_slice")).applyInPandas(run, schema)
    scored = scored.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(reads)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(reads)]
    return rows.join(scored, same, "inner").select(*rows.columns, *[f.name for f in schema.fields[len(reads):]])


class CountScorer:
    """Add-alpha next-token scores: reads (ctx, nxt) and the context's total C (null: unseen), model rows
    (ctx, nxt, n); makes n, p and nll."""

    columns = ("ctx", "nxt", "C")
    schema = "n long, p double, nll double"

    def __init__(self, vocab_size: int, alpha: float = 1.0):
        self.vocab_size, self.alpha = vocab_size, alpha

    def score(self, batch: pd.DataFrame, model: pd.DataFrame | None = None) -> pd.DataFrame:
        n = batch.merge(model, on=["ctx", "nxt"], how="left")["n"].fillna(0).to_numpy(np.int64)
        p = (n + self.alpha) / (batch["C"].fillna(0).to_numpy(float) + self.alpha * self.vocab_size)
        return pd.DataFrame({"n": n, "p": p, "nll": -np.log(p)})


class TreeScorer:
    """Predictions of a fitted Spark ML tree regressor (one tree or a weighted ensemble, numeric splits). Null and
    missing features count as zero."""

    schema = "pred double"

    def __init__(self, model, features: Sequence[str]):
        self.columns = tuple(features)
        trees, weights = (model.trees, model.treeWeights) if hasattr(model, "trees") else ([model], [1.0])
        self.trees = [(w, self._table(tree._call_java("rootNode"))) for w, tree in zip(weights, trees)]

    @staticmethod
    def _table(root) -> np.ndarray:
        """Nodes as rows (feature or -1, threshold or value, left, right), children after their parent."""
        nodes, table = [root], []
        for node in nodes:
            if node.subtreeDepth() == 0:
                table.append((-1.0, float(node.prediction()), 0.0, 0.0))
            else:
                split, at = node.split(), len(nodes)
                nodes += [node.leftChild(), node.rightChild()]
                table.append((float(split.featureIndex()), float(split.threshold()), float(at), float(at + 1)))
        return np.array(table)

    def score(self, batch: pd.DataFrame, model: pd.DataFrame | None = None) -> pd.DataFrame:
        x = np.nan_to_num(batch[list(self.columns)].to_numpy(float), nan=0.0, posinf=np.inf, neginf=-np.inf)
        pred = np.zeros(len(x))
        for weight, table in self.trees:
            at = np.zeros(len(x), dtype=int)
            while (inner := np.flatnonzero(table[at, 0] >= 0)).size:
                node = table[at[inner]]
                left = x[inner, node[:, 0].astype(int)] <= node[:, 1]
                at[inner] = np.where(left, node[:, 2], node[:, 3]).astype(int)
            pred += weight * table[at, 1]
        return pd.DataFrame({"pred": pred})

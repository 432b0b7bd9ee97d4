"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the matching oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MODULES = ("q_text", "q_sampling", "q_runlog", "q_stats", "q_lm", "q_decode", "q_vectors", "q_sources", "q_streams")


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def finish(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Round every floating column (the oracle rounds the same columns). Large-magnitude
    columns such as perplexity get fewer decimals so sum-order noise cannot flip a digit."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = per_column.get(f.name, digits)
            scale = F.lit(float(10 ** d))
            # scale, round half away from zero, unscale: the same double as SQL round(x, d)
            cols.append((F.round(F.col(f.name).cast("double") * scale, 0) / scale).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"corpuslab.plans.{m}")

"""Keyed hash draws: repeatable, partition-independent uniform numbers.

``u(seed, key) = int(first 8 hex digits of md5(seed|key), 16) / 2**32``. The same value is
computable in any SQL engine with md5, which is what makes sampling operators checkable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(k) -> Column:
    return F.col(k) if isinstance(k, str) else k


def hash_key(seed, *keys) -> Column:
    parts = [F.lit(str(seed))] + [_as_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def draw(seed, *keys) -> Column:
    """Uniform double in [0, 1) from (seed, keys)."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def draw_sql(seed, *key_sql: str) -> str:
    """The same draw in DuckDB SQL (used by the oracle strings)."""
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return f"(('0x' || substr(md5({inner}), 1, 8))::BIGINT / 4294967296.0)"

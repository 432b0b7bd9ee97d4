"""Run registered queries in Spark and their oracle SQL in DuckDB; compare row count, column
names and order-insensitive rounded values.  Usage: python tests/oracle_check.py [names...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from corpuslab.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "NULL"
    if isinstance(v, (float, np.floating)):
        if math.isnan(v):
            return "NULL"
        return f"{round(float(v), 6):.6f}"
    if isinstance(v, (np.ndarray, list, tuple)):
        return "[" + ",".join(_norm(x) for x in list(v)) + "]"
    if isinstance(v, (np.integer,)):
        return str(int(v))
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TO_DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
                 "BooleanType": "BOOLEAN", "FloatType": "FLOAT", "ShortType": "SMALLINT"}


def type_diffs(sdf, con, sql):
    """Column types that differ between the Spark result and the oracle (by name)."""
    rel = con.sql(sql)
    duck = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    out = []
    for f in sdf.schema.fields:
        st = SPARK_TO_DUCK.get(type(f.dataType).__name__, type(f.dataType).__name__)
        if f.name in duck and duck[f.name] != st:
            out.append(f"{f.name}:{st}!={duck[f.name]}")
    return out


def check(spark, names=None, sf_dir="/root/testdata/sf0.01", verbose=True):
    import __spark_entry__ as e

    qs, sqls = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            spdf = sdf.toPandas()
        except Exception as ex:  # noqa: BLE001
            results[name] = f"SPARK-ERROR {type(ex).__name__}: {str(ex)[:300]}"
            print(name, results[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = f"rows-only {len(spdf)}"
            print(f"{name:28s} rows-only rows={len(spdf)} spark={ts:.1f}s", flush=True)
            continue
        try:
            dpdf = con.execute(sqls[name]).df()
        except Exception as ex:  # noqa: BLE001
            results[name] = f"SQL-ERROR {str(ex)[:300]}"
            print(name, results[name], flush=True)
            continue
        sc, sr = rows_of(spdf)
        dc, dr = rows_of(dpdf)
        ok = sc == dc and sr == dr
        msg = "OK" if ok else "MISMATCH"
        tdiff = type_diffs(sdf, con, sqls[name])
        if tdiff:
            msg += f" TYPES {tdiff}"
        if not ok:
            if sc != dc:
                msg += f" cols spark={sc} sql={dc}"
            elif len(sr) != len(dr):
                msg += f" rows spark={len(sr)} sql={len(dr)}"
            else:
                diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
                msg += f" first diffs {diff}"
        results[name] = msg
        if verbose:
            print(f"{name:28s} {msg[:600]} rows={len(spdf)} spark={ts:.1f}s", flush=True)
    return results


if __name__ == "__main__":
    from corpuslab.session import get_spark

    spark = get_spark()
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    res = check(spark, args or None, sf)
    bad = [k for k, v in res.items() if not (v == "OK" or v.startswith("rows-only"))]
    print(f"{len(res) - len(bad)}/{len(res)} ok; bad: {bad}")

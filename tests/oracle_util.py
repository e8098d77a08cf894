"""Side-by-side comparison of a Spark query with its DuckDB SQL oracle."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

from leadlens.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).tz_localize(None).isoformat() if getattr(v, "tzinfo", None) else pd.Timestamp(v).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        import numpy as np
        if isinstance(v, np.ndarray):
            return tuple(_norm(x) for x in v.tolist())
        if isinstance(v, np.generic):
            return _norm(v.item())
    except ImportError:
        pass
    return v


def compare(spark_df, con, sql: str):
    """Return (ok, message)."""
    s = spark_df.toPandas()
    d = con.execute(sql).df()
    if sorted(s.columns) != sorted(d.columns):
        return False, f"columns differ: spark={sorted(s.columns)} sql={sorted(d.columns)}"
    cols = sorted(s.columns)
    if len(s) != len(d):
        return False, f"row count spark={len(s)} sql={len(d)}"
    srows = sorted((tuple(_norm(v) for v in r) for r in s[cols].itertuples(index=False)), key=repr)
    drows = sorted((tuple(_norm(v) for v in r) for r in d[cols].itertuples(index=False)), key=repr)
    bad = [(a, b) for a, b in zip(srows, drows) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. spark={bad[0][0]} sql={bad[0][1]}"
    return True, f"{len(s)} rows match"

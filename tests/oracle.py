"""Run a DuckDB twin over the same Parquet tables and compare rows as multisets."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


def rows(df: pd.DataFrame) -> Counter:
    df = df[sorted(df.columns)].astype(object)
    return Counter(tuple(map(_plain, r)) for r in df.itertuples(index=False))

"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf: str):
    con = duckdb.connect()
    for f in sorted(glob.glob(f"{sf}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v)) else str(v))
    return df.sort_values(list(df.columns), na_position="last", ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = tidy(got), tidy(want)
    for c in a.columns:
        ka, kb = a[c].dtype.kind, b[c].dtype.kind
        if {ka, kb} - {"f"} and ka != kb and not {ka, kb} <= {"O", "b"} and not {ka, kb} <= {"f", "i"} :
            return f"{c}: type {a[c].dtype} != {b[c].dtype}"
        x, y = a[c], b[c]
        bad = ~((x == y) | (x.isna() & y.isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{c}: {int(bad.sum())} of {len(a)} differ, first {x[i]!r} != {y[i]!r}\n{a.loc[i].to_dict()}\n{b.loc[i].to_dict()}"
    return None

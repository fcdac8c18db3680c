"""Least squares per series from summed cross products.

Each block of a series contributes the cross products of its design rows (numpy inside the
task, one Arrow column of values in); Spark adds them up per (series, cell) and the small
system of each series is solved afterwards.  No task ever sees more than one block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..shared import as_micros, from_micros
from .panel import Panel


def block_sums(p: Panel, df: DataFrame, fn: Callable[[dict[str, np.ndarray]], np.ndarray], before: int) -> DataFrame:
    """Elementwise sum of one vector per block: (keys, sums array<double>).

    ``df`` holds the ordered columns ``fn`` needs; ``fn`` gets them as arrays in order (border
    rows included, with ``idx``, ``n`` and ``core``) and returns the vector of that block."""
    blocks, _ = p.blocked(before, 0, df=df)
    keys = p.keys
    schema = T.StructType([*as_micros(df.select(*keys)).schema.fields, T.StructField("cells", T.ArrayType(T.DoubleType()))])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        cells = fn({c.strip("_"): table[c].to_numpy(zero_copy_only=False) for c in table.column_names if c not in keys})
        arr = pa.array([cells.tolist()], pa.list_(pa.float64()))
        return table.select(keys).slice(0, 1).append_column("cells", arr) if keys else pa.table({"cells": arr})

    need = [c for c in blocks.columns if c not in (p.spec.time, *p.spec.tie)]
    parts = from_micros(as_micros(blocks.select(*need)).groupBy(*keys, "__block").applyInArrow(run, schema), df.select(*keys))
    cells = parts.select(*keys, F.posexplode("cells").alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda r: r["v"])
    return cells.groupBy(*keys).agg(packed.alias("sums"))


def gram(p: Panel, df: DataFrame, design: Callable[[dict[str, np.ndarray]], np.ndarray], width: int, before: int) -> DataFrame:
    """Sum of ``Z^T Z`` per series, where ``design`` gives the rows Z of a block: (keys, gram)."""
    def cells(cols):
        z = design(cols)
        return (z.T @ z).ravel() if len(z) else np.zeros(width * width)
    return block_sums(p, df, cells, before).withColumnRenamed("sums", "gram")


def lag_sums(p: Panel, df: DataFrame, value: str, max_lag: int) -> DataFrame:
    """Lagged products of a centred column for lags 0..max_lag: (keys, sums)."""
    name = value.strip("_")

    def products(cols):
        e, first = cols[name], int(np.argmax(cols["core"]))
        out = np.zeros(max_lag + 1)
        for k in range(min(max_lag, len(e) - 1) + 1):
            start = max(first, k)
            out[k] = e[start:] @ e[start - k:len(e) - k]
        return out

    return block_sums(p, df, products, max_lag)


def solve(g: np.ndarray, y: int, x: list[int]):
    """Regress column ``y`` on columns ``x``: (coefficients, residual sum of squares, inverse)."""
    a = g[np.ix_(x, x)]
    b = g[x, y]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    inv = np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-13, hermitian=True) / np.outer(scale, scale)
    beta = inv @ b
    return beta, float(max(g[y, y] - beta @ b, 0.0)), inv

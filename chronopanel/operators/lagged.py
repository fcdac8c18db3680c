"""Lagged products of every beginning of a series, in one pass.

Regressions on lags of a series need only ``C[k] = sum of z[s] * z[s-k]`` over the rows before an
origin, the sum of z and the few values at both ends: the cross products of the design matrix
are these sums less the products at the ends.  A block of a series gives the sums of its
stretches between origins, a running sum over the (few) stretches of a series gives the sums of
every beginning.  So any number of origins costs one pass over the rows, and what travels grows
with lags + origins, not with their product with the rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.scalar import is_finite
from ..shared import BROADCAST_ROWS, as_micros, from_micros, key_join
from .panel import Panel

EXTRA = 6  # per level after the lagged products: sum z, sum V, sum V^2, sum (t+1)V, rows, sum (t+1); V is the running sum of z


def prefix_sums(p: Panel, lags: tuple[int, ...], origins: DataFrame | None = None, n_origins: int = 1) -> DataFrame:
    """Sums over the rows before each origin: (keys, fit_rows, cells, head, tail, mean, std).

    ``fit_rows`` is the origin, the number of rows summed.  ``lags[d]``: greatest lag for the series differenced d times.  ``origins``: distinct (keys,
    origin), at most ``n_origins`` a series; None: the whole series.  The target holds no nulls.
    Sums are those of (value - mean) / std (0 for a constant series), where both are taken over the
    finite values of the whole series; ``head`` and ``tail`` are the first and last values before the origin as they are.
    ``level_sums`` reads ``cells``.  A value that is not finite makes the sums of every later origin NaN."""
    reach = max(lags) + len(lags)
    keys, y = p.keys, p.y.cast("double")
    finite = F.when(is_finite(y), y)
    scale = p.aggregate(F.coalesce(F.avg(finite), F.lit(0.0)).alias("__mean"), F.coalesce(F.stddev_pop(finite), F.lit(0.0)).alias("__std"))
    rows = p.attach(p.df.select(*keys, p.spec.time, *p.spec.tie, y.alias("__v")), scale)
    blocks, _ = p.blocked(reach, 0, df=rows)
    if origins is None:
        blocks = blocks.withColumn("__mark", F.col("idx") == F.col("n") - 1)
    else:
        marks = origins.select(*keys, (F.col("origin") - 1).alias("idx"), F.lit(True).alias("__mark")).distinct()
        marks = F.broadcast(marks) if p.n_series * n_origins <= BROADCAST_ROWS else marks
        blocks = key_join(blocks, marks, [*keys, "idx"], "left")
    doubles = T.ArrayType(T.DoubleType())
    names = as_micros(rows.select(*keys)).schema.fields
    ends = [T.StructField("cells", doubles), T.StructField("head", doubles), T.StructField("tail", doubles),
            T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())]
    pieces = T.StructType([*names, T.StructField("__end", T.LongType()), T.StructField("__mark", T.BooleanType()), *ends])

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        v, idx, core = (table[c].to_numpy(zero_copy_only=False) for c in ("__v", "idx", "__core"))
        mark = np.flatnonzero(table["__mark"].fill_null(False).to_numpy(zero_copy_only=False) & core)
        own = np.flatnonzero(core)
        if not len(own):
            return pa.table({f.name: [] for f in pieces.fields}, schema=arrow_schema(table, keys))
        first, last = int(own[0]), int(own[-1])
        mean, std = table["__mean"][0].as_py(), table["__std"][0].as_py()
        ends = np.unique(np.append(mark, last))  # last row of each stretch
        cells = stretch_cells((v - mean) / std if std > 0 else np.where(np.isfinite(v), 0.0, v), idx, first, ends, lags)
        marked = np.isin(ends, mark)
        none = np.zeros(0)
        head = [v[first:last + 1][idx[first:last + 1] < reach] if i == 0 else none for i in range(len(ends))]
        tail = [v[max(0, e + 1 - reach):e + 1] if m else none for e, m in zip(ends, marked)]
        n, lists = len(ends), pa.list_(pa.float64())
        cols = [pa.chunked_array([pa.repeat(table[k][0], n)]) for k in keys]
        cols += [pa.array(idx[ends] + 1, pa.int64()), pa.array(marked), pa.array(list(cells), lists), pa.array(head, lists), pa.array(tail, lists),
                 pa.array(np.full(n, mean)), pa.array(np.full(n, std))]
        return pa.Table.from_arrays(cols, schema=arrow_schema(table, keys))

    def arrow_schema(table, keys):
        lists = pa.list_(pa.float64())
        return pa.schema([*[table.schema.field(k) for k in keys], ("__end", pa.int64()), ("__mark", pa.bool_()), ("cells", lists), ("head", lists),
                          ("tail", lists), ("mean", pa.float64()), ("std", pa.float64())])

    need = [c for c in blocks.columns if c not in (p.spec.time, *p.spec.tie) or c in keys]
    parts = as_micros(blocks.select(*need)).groupBy(*keys, "__block").applyInArrow(cut, pieces)
    points = T.StructType([*names, T.StructField("fit_rows", T.LongType()), *ends])

    def run_up(table: pa.Table) -> pa.Table:
        table = table.sort_by("__end")
        cells = np.array(table["cells"].to_pylist(), float)
        head = np.concatenate([np.asarray(h, float) for h in table["head"].to_pylist()])[:reach]
        cells = prefixes(cells, lags)
        take = np.flatnonzero(table["__mark"].to_numpy(zero_copy_only=False))
        got, end = table.take(take), table["__end"].to_numpy()[take]
        lists = pa.list_(pa.float64())
        cols = {**{k: got[k] for k in keys}, "fit_rows": got["__end"], "cells": pa.array(list(cells[take]), lists),
                "head": pa.array([head[:int(e)] for e in end], lists), "tail": got["tail"], "mean": got["mean"], "std": got["std"]}
        return pa.table(cols)

    return from_micros(parts.withColumn("__one", F.lit(0)).groupBy(*keys, "__one").applyInArrow(run_up, points), rows.select(*keys))


def stretch_cells(v: np.ndarray, idx: np.ndarray, first: int, ends: np.ndarray, lags: tuple[int, ...]) -> np.ndarray:
    """One row of cells per stretch: rows ``first`` to ends[0], then on to ends[1], and so on."""
    last = int(ends[-1])
    starts = np.append(first, ends[:-1] + 1)
    out, z, size = [], v.copy(), last + 1 - first
    for d, most in enumerate(lags):
        if d:
            z = np.diff(z, prepend=z[:1])
        z[idx < d] = 0.0
        padded = np.concatenate([np.zeros(most), z])
        here = padded[most + first:most + last + 1]
        for k in range(most + 1):
            out.append(np.add.reduceat(here * padded[most + first - k:most + last + 1 - k], starts - first))
        counted = (idx[first:last + 1] >= d).astype(float)
        place = np.maximum(idx[first:last + 1] - d + 1, 0).astype(float)
        total = np.cumsum(here)
        before = np.concatenate([[0.0], total])[starts - first]
        running = (total - np.repeat(before, np.diff(np.append(starts, last + 1)))) * counted
        for x in (here, running, running * running, place * running, counted, place):
            out.append(np.add.reduceat(x, starts - first))
    return np.array(out).T


def prefixes(cells: np.ndarray, lags: tuple[int, ...]) -> np.ndarray:
    """Cells of consecutive stretches to those of all beginnings: running sums go on where the last stretch ended."""
    cells, at = cells.copy(), 0
    for most in lags:
        s, v, vv, wv, m, w = (cells[:, at + most + 1 + i] for i in range(EXTRA))
        off = np.cumsum(s) - s
        vv += 2 * off * v + off * off * m
        v += off * m
        wv += off * w
        at += most + 1 + EXTRA
    return np.cumsum(cells, axis=0)


def level_sums(cells: np.ndarray, lags: tuple[int, ...], d: int):
    """(lagged products, sum, sum V, sum V^2, sum (t+1)V) of the series differenced ``d`` times."""
    at = sum(lags[:d]) + d * (1 + EXTRA)
    c = cells[at:at + lags[d] + 1]
    return (c, *cells[at + lags[d] + 1:at + lags[d] + 5])


def lagged_gram(c: np.ndarray, total: float, head: np.ndarray, tail: np.ndarray, n: int, most: int, start: int) -> np.ndarray:
    """Cross products of (z[t], 1, z[t-1], .., z[t-most]) over ``start`` <= t < ``n`` (start >= most) from
    the lagged products ``c`` of all n values, their sum, the first ``start`` and the last ``most`` values."""
    g = np.zeros((most + 1, most + 1))
    if n <= start:
        return np.zeros((most + 2, most + 2))
    back = tail[::-1]
    for k in range(most + 1):
        i = np.arange(most + 1 - k)
        low = np.concatenate([[0.0], np.cumsum(head[k:start] * head[:start - k])])
        high = np.concatenate([[0.0], np.cumsum(back[:most - k] * back[k:most])])
        g[i, i + k] = g[i + k, i] = c[k] - low[start - i - k] - high[i]
    i = np.arange(most + 1)
    sums = total - np.concatenate([[0.0], np.cumsum(head[:start])])[start - i] - np.concatenate([[0.0], np.cumsum(back[:most])])[i]
    order = [0, *range(2, most + 2)]
    out = np.empty((most + 2, most + 2))
    out[np.ix_(order, order)] = g
    out[1, order] = out[order, 1] = sums
    out[1, 1] = n - start
    return out


def nested_rss(g: np.ndarray, y: int, x: list[int]) -> np.ndarray:
    """Residual sums of squares of column ``y`` on the first 1, 2, .. columns of ``x``, by one
    elimination; a column that the earlier ones explain adds nothing."""
    order = [*x, y]
    a = g[np.ix_(order, order)]
    size = np.sqrt(np.maximum(np.diag(a), 1e-300))
    a = a / np.outer(size, size)
    out = []
    for j in range(len(x)):
        if a[j, j] > 1e-13:
            a[j + 1:, j + 1:] -= np.outer(a[j + 1:, j], a[j, j + 1:]) / a[j, j]
        out.append(max(a[-1, -1], 0.0) * size[-1] ** 2)
    return np.array(out)

"""ARIMA by Hannan-Rissanen regressions on lagged products (see ``lagged``).

Differencing order by repeated level-stationarity tests, a long autoregression, and every
(p, q) order from one matrix of cross products; the lowest AIC wins.  The residuals of the long
autoregression are linear in the lags, so their cross products follow from those of the series:
no pass computes residuals, and all origins of a series are fitted from one pass over its rows.
The history is used whole, however long a series is."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.scalar import is_finite
from .gram import solve
from .lagged import lagged_gram, level_sums, prefix_sums
from .naive import steps
from .panel import Panel
from .stationarity import KPSS_POINTS

MAX_P, MAX_D, MAX_Q = 5, 2, 5
LONG_AR = 12
LEVEL = 0.05
# residuals below this share of the series' squares are rounding, not shocks
SHOCK = 1e-11


def fit_arima(p: Panel, max_p: int = MAX_P, max_q: int = MAX_Q, d: int | None = None, origins: DataFrame | None = None,
              n_origins: int = 1) -> DataFrame:
    """One row per series and origin: fit_rows (the origin), p, d, q, aic, coefficients and the tails needed to forecast.

    ``origins``: (keys, origin), at most ``n_origins`` a series; a fit sees the rows before its
    origin.  None: one fit on all rows that have a target.  p is null where no order can be fitted
    (too few rows, or a value before the origin that is not finite)."""
    reach = max(max_p, max_q)
    lags = (max(LONG_AR + max_q, max_p, _short_lags(p.longest)),) * (MAX_D + 1)
    # the ends must hold the rows that the regressions leave out
    lags = tuple(max(k, LONG_AR + reach) for k in lags)
    points = prefix_sums(p.derive(p.df.where(p.y.isNotNull())), lags, origins, n_origins)
    if origins is not None:
        points = points.repartition(*p.keys, "fit_rows")
    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[points.schema[k] for k in p.keys], T.StructField("fit_rows", T.LongType()), T.StructField("p", T.IntegerType()),
                           T.StructField("d", T.IntegerType()), T.StructField("q", T.IntegerType()), T.StructField("aic", T.DoubleType()),
                           T.StructField("beta", arr), T.StructField("z_tail", arr), T.StructField("e_tail", arr), T.StructField("ends", arr)])
    keys = p.keys

    def run(batches):
        for b in batches:
            fits = pd.DataFrame([_fit(r, lags, max_p, max_q, d) for r in b.itertuples()],
                                columns=["p", "d", "q", "aic", "beta", "z_tail", "e_tail", "ends"])
            fits[["p", "d", "q"]] = fits[["p", "d", "q"]].astype("Int32")
            yield pd.concat([b[[*keys, "fit_rows"]].reset_index(drop=True), fits], axis=1)[[f.name for f in schema.fields]]

    return points.mapInPandas(run, schema)


def _short_lags(n: int) -> int:
    return int(4 * (n / 100) ** 0.25)


def _level_pvalue(cells, lags, d: int, head: np.ndarray, tail: np.ndarray, n: int) -> float:
    """Level-stationarity test with short Bartlett lags of the first ``n`` values; 1 where they do not vary."""
    if n < 1:
        return 1.0
    c, total, v, vv, wv = level_sums(cells, lags, d)
    m, most = total / n, min(_short_lags(n), n - 1)
    k = np.arange(most + 1)
    left = total - np.concatenate([[0.0], np.cumsum(head)])[k]
    right = total - np.concatenate([[0.0], np.cumsum(tail[::-1])])[k]
    cov = c[:most + 1] - m * (left + right) + (n - k) * m * m
    if cov[0] <= 1e-12 * c[0]:
        return 1.0
    # running sums of the centred values: V[t] - (t + 1) m
    eta = vv - 2 * m * wv + m * m * n * (n + 1) * (2 * n + 1) / 6
    spread = cov[0] + 2 * ((1 - k[1:] / (_short_lags(n) + 1)) * cov[1:]).sum()
    if spread == 0:
        return 1.0
    return float(np.interp(eta / n / spread, *zip(*KPSS_POINTS)))


def _fit(r, lags: tuple[int, ...], max_p: int, max_q: int, d: int | None):
    raw_head, raw_tail, cells = (np.asarray(x, float) for x in (r.head, r.tail, r.cells))
    ends, nothing = raw_tail[-2:].tolist(), (None, None, None, None, None, None, None, raw_tail[-2:].tolist())
    if not np.isfinite(cells).all():
        return nothing
    std = r.std if r.std > 0 else 1.0
    head, tail = (raw_head - r.mean) / std, (raw_tail - r.mean) / std
    if d is None:
        p0 = _level_pvalue(cells, lags, 0, head, tail, r.fit_rows)
        d = 0 if p0 >= LEVEL else 1 if _level_pvalue(cells, lags, 1, np.diff(head), np.diff(tail), r.fit_rows - 1) >= LEVEL else MAX_D
    head, tail, n = np.diff(head, d), np.diff(tail, d), int(r.fit_rows) - d
    reach, most = max(max_p, max_q), max(LONG_AR + max_q, max_p)
    if n - LONG_AR - reach <= 4:
        return nothing
    c, total, *_ = level_sums(cells, lags, d)
    phi = solve(lagged_gram(c, total, head, tail, n, LONG_AR, LONG_AR), 0, list(range(1, LONG_AR + 2)))[0]
    g = lagged_gram(c, total, head, tail, n, most, LONG_AR + reach)
    # rows of (z, 1, z lags, e lags) in terms of (z, 1, z lags)
    rows = np.zeros((2 + max_p + max_q, most + 2))
    rows[np.arange(2 + max_p), np.arange(2 + max_p)] = 1.0
    for k in range(1, max_q + 1):
        at = rows[1 + max_p + k]
        at[1 + k], at[1] = 1.0, -phi[0]
        at[2 + k:2 + k + LONG_AR] -= phi[1:]
    design = rows @ g @ rows.T
    rounding = np.diag(design) <= SHOCK * max(g[0, 0], 0.0)
    rounding[:2 + max_p] = False
    design[rounding], design[:, rounding] = 0.0, 0.0
    p, q, aic, beta = _pick_order(design, d, max_p, max_q)
    if p is None:
        return nothing
    mean = r.mean if d == 0 else 0.0
    beta = [std * beta[0] + mean * (1 - sum(beta[1:1 + p])), *beta[1:]] if d <= 1 else beta
    z = tail[-max(reach, 1):]
    e = [tail[t] - phi[0] - phi[1:] @ tail[t - LONG_AR:t][::-1] for t in range(len(tail) - len(z), len(tail))]
    return p, d, q, aic + 2 * g[1, 1] * math.log(std), beta, (std * z + mean).tolist(), (std * np.asarray(e)).tolist(), ends


def _stable(coef: np.ndarray) -> bool:
    if not len(coef):
        return True
    companion = np.zeros((len(coef), len(coef)))
    companion[0] = coef
    companion[1:, :-1] += np.eye(len(coef) - 1)
    return bool(np.max(np.abs(np.linalg.eigvals(companion))) < 0.999)


def _pick_order(g: np.ndarray, d: int, max_p: int, max_q: int):
    rows = g[1, 1]
    best = (None, None, None, None)
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            if rows <= 2 * (p + q + 2):
                continue
            const = [1] if d <= 1 else []
            x = [*const, *range(2, 2 + p), *range(2 + max_p, 2 + max_p + q)]
            if x:
                beta, rss, _ = solve(g, 0, x)
            else:
                beta, rss = np.zeros(0), g[0, 0]
            lead = len(const)
            ar, ma = beta[lead:lead + p], beta[lead + p:]
            if not (_stable(ar) and _stable(-ma)):
                continue
            aic = rows * math.log(max(rss, 1e-300) / rows) + 2 * (len(x) + 1)
            if best[2] is None or aic < best[2]:
                best = (p, q, aic, [beta[0] if const else 0.0, *ar, *ma])
    return best


def arima(p: Panel, horizon: int, max_p: int = MAX_P, max_q: int = MAX_Q, d: int | None = None) -> DataFrame:
    """M3: forecasts of the chosen order; a series too short for any order repeats its last
    value (``fallback``)."""
    return _forecast(p, fit_arima(p, max_p, max_q, d), horizon).drop("fit_rows")


def arima_at(p: Panel, origins: DataFrame, horizon: int, n_origins: int, max_p: int = MAX_P, max_q: int = MAX_Q, d: int | None = None) -> DataFrame:
    """M3 refitted at every origin, from one pass over the rows: (keys, origin, h, yhat, fallback).
    Every row has a target (origins count rows)."""
    return _forecast(p, fit_arima(p, max_p, max_q, d, origins, n_origins), horizon).withColumnRenamed("fit_rows", "origin")


arima.at_origins = arima_at


def _forecast(p: Panel, fit: DataFrame, horizon: int) -> DataFrame:
    keys = [*p.keys, "fit_rows"]
    schema = T.StructType([*[fit.schema[k] for k in keys], T.StructField("last", T.DoubleType()), T.StructField("path", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            made = [_path(r, horizon) if pd.notna(r.p) else None for r in b.itertuples()]
            yield b[keys].reset_index(drop=True).assign(last=[r.ends[-1] for r in b.itertuples()], path=made)

    got = F.get("path", F.col("h") - 1)
    ok = is_finite(got)
    out = steps(fit.mapInPandas(run, schema), horizon)
    return out.select(*keys, "h", F.when(ok, got).otherwise(F.col("last")).alias("yhat"), (~ok).alias("fallback"))


def _path(r, horizon: int) -> list[float]:
    beta, d, p, q = np.asarray(r.beta, float), int(r.d), int(r.p), int(r.q)
    z, e = list(r.z_tail), list(r.e_tail)
    for _ in range(horizon):
        v = beta[0] + sum(beta[k] * z[-k] for k in range(1, p + 1)) + sum(beta[p + k] * e[-k] for k in range(1, q + 1))
        z.append(v)
        e.append(0.0)
    path = np.asarray(z[-horizon:])
    ends = list(r.ends)
    if d == 1:
        path = ends[-1] + np.cumsum(path)
    elif d == 2:
        path = ends[-1] + np.cumsum((ends[-1] - ends[-2]) + np.cumsum(path))
    return path.tolist()

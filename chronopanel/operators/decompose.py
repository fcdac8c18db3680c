"""Seasonal decomposition: classical (windows only) and robust STL."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..shared import as_micros, from_micros, key_join, stage
from .panel import Panel
from .quantiles import interpolate, order_statistics

SEASONAL_SPAN = 7
INNER_PASSES = 2
ROBUST_PASSES = 15
CANDIDATE_PERIODS = (7, 12, 24, 30, 365)


def classical(p: Panel, period: int) -> DataFrame:
    """Centred moving average of one period as trend, centred phase means as seasonal.

    Adds idx, n, trend, seasonal, resid; null where the moving average is incomplete or the
    series is shorter than two periods."""
    y = p.y.cast("double")
    half = period // 2
    frame = lambda w: w.rowsBetween(-half, half)

    def average(w):
        total = F.sum(y).over(frame(w))
        if period % 2 == 0:
            total = total - 0.5 * (F.lag(y, half).over(w) + F.lead(y, half).over(w))
        full = (F.col("idx") >= half) & (F.col("idx") < F.col("n") - half) & (F.col("n") >= 2 * period)
        return {"trend": F.when(full, total / period)}

    d = p.over(average, before=half, after=half).withColumn("__phase", F.col("idx") % period)
    means = d.groupBy(*p.keys, "__phase").agg(F.avg(y - F.col("trend")).alias("__m"))
    centre = means.groupBy(*p.keys).agg(F.avg("__m").alias("__c"))
    season = p.attach(means, centre).select(*p.keys, "__phase", (F.col("__m") - F.col("__c")).alias("seasonal"))
    if p.n_series * period <= 200_000:
        season = F.broadcast(season)
    out = key_join(d, season, [*p.keys, "__phase"]).drop("__phase")
    return out.withColumn("resid", y - F.col("trend") - F.col("seasonal"))


# ---- STL: numpy kernel over one block ------------------------------------------------------

def _next_odd(x: float) -> int:
    k = int(np.ceil(x))
    return k if k % 2 else k + 1


def trend_span(period: int) -> int:
    return _next_odd(1.5 * period / (1 - 1.5 / SEASONAL_SPAN))


def lowpass_span(period: int) -> int:
    return _next_odd(period + 1)


def _near_weight(dist: np.ndarray, reach) -> np.ndarray:
    """Tricube weight of a distance, flat at the centre and zero at the end of the window."""
    return np.where(dist <= 0.001 * reach, 1.0, np.where(dist <= 0.999 * reach, (1 - (dist / reach) ** 3) ** 3, 0.0))


def _loess(rows: np.ndarray, span: int, at: np.ndarray, whole, weights: np.ndarray | None = None) -> np.ndarray:
    """Local linear smoothing of equally spaced rows (m x k) at consecutive positions ``at``; the
    row value itself where all weights vanish.  ``whole``: values in the series each row is a part
    of (one number, or one per row); a slope needs a spread in proportion to it.

    Where the window is centred its weights do not depend on the position, so the weighted sums
    are convolutions; only the positions near the ends are fitted one by one."""
    m, k = rows.shape
    half = (span - 1) // 2
    lo, hi = max(half, at[0]), min(k - half, at[-1] + 1)  # centred positions
    if span > k or hi <= lo:
        return _loess_each(rows, span, at, whole, weights)
    least = 0.001 * (np.broadcast_to(np.asarray(whole, float), (m,)) - 1)
    d = np.arange(-half, half + 1, dtype=float)
    kernel = _near_weight(np.abs(d), float(half))
    out = np.empty((m, len(at)))
    w = np.ones_like(rows) if weights is None else weights
    for i in range(m):
        total = lambda x, f: np.convolve(x, f[::-1], "valid")[lo - half:hi - half]
        s0, s1, s2 = (total(w[i], kernel * d ** e) for e in range(3))
        t0, t1 = (total(w[i] * rows[i], kernel * d ** e) for e in range(2))
        ok = s0 > 0
        safe = np.where(ok, s0, 1.0)
        centre = s1 / safe
        var = np.maximum(s2 / safe - centre ** 2, 0.0)
        slope_ok = np.sqrt(var) > least[i]
        tilt = np.where(slope_ok, -centre / np.where(slope_ok, var, 1.0), 0.0)
        fit = (t0 + tilt * (t1 - centre * t0)) / safe
        out[i, lo - at[0]:hi - at[0]] = np.where(ok, fit, rows[i, lo:hi])
    for edge in (np.arange(0, lo - at[0]), np.arange(hi - at[0], len(at))):
        if len(edge):
            out[:, edge] = _loess_each(rows, span, at[edge], whole, weights)
    return out


def _loess_each(rows: np.ndarray, span: int, at: np.ndarray, whole, weights: np.ndarray | None = None) -> np.ndarray:
    m, k = rows.shape
    least = 0.001 * (np.broadcast_to(np.asarray(whole, float), (m,)) - 1)[:, None, None]
    size = min(span, k)
    out = np.empty((m, len(at)))
    chunk = max(1, 4_000_000 // max(1, m * size))
    for start in range(0, len(at), chunk):
        x = at[start:start + chunk]
        left = np.clip(x - (span - 1) // 2, 0, k - size)
        near = left[:, None] + np.arange(size)
        dist = np.abs(near - x[:, None]).astype(float)
        reach = np.maximum(x - left, left + size - 1 - x).astype(float)
        if span > k:
            reach += (span - k) // 2
        reach = np.maximum(reach, 1e-12)[:, None]
        base = _near_weight(dist, reach)
        w = base[None] if weights is None else base[None] * weights[:, near]
        total = w.sum(axis=2, keepdims=True)
        ok = total[..., 0] > 0
        w = w / np.where(total > 0, total, 1.0)
        centre = (w * near).sum(axis=2, keepdims=True)
        off = near[None] - centre
        var = (w * off ** 2).sum(axis=2, keepdims=True)
        slope_ok = np.sqrt(var) > least
        tilt = np.where(slope_ok, (x[None, :, None] - centre) / np.where(slope_ok, var, 1.0), 0.0)
        fit = (w * (1 + tilt * off) * rows[:, near]).sum(axis=2)
        out[:, start:start + chunk] = np.where(ok, fit, rows[:, np.clip(x, 0, k - 1)])
    return out


def _moving_mean(x: np.ndarray, length: int) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(x)])
    return (c[length:] - c[:-length]) / length


def stl_pass(y: np.ndarray, trend: np.ndarray, weights: np.ndarray | None, period: int, start: int = 0, whole: int | None = None):
    """The inner loop: returns the new (trend, seasonal).  ``y`` may be the part of a series of
    ``whole`` rows that begins at ``start``."""
    n = len(y)
    whole = n if whole is None else whole
    everywhere = np.arange(n)
    seasonal = np.zeros(n)
    for _ in range(INNER_PASSES):
        cycle = np.empty(n + 2 * period)
        for members in (np.arange(0, n % period), np.arange(n % period, period)):
            if not len(members):
                continue
            k = (n - members[0] - 1) // period + 1
            where = members[:, None] + period * np.arange(k)
            w = None if weights is None else weights[where]
            cycles = (whole - (start + members) % period - 1) // period + 1
            smooth = _loess(y[where] - trend[where], SEASONAL_SPAN, np.arange(-1, k + 1), cycles, w)
            cycle[members[:, None] + period * np.arange(k + 2)] = smooth
        low = _moving_mean(_moving_mean(_moving_mean(cycle, period), period), 3)
        low = _loess(low[None], lowpass_span(period), everywhere, whole)[0]
        seasonal = cycle[period:period + n] - low
        trend = _loess((y - seasonal)[None], trend_span(period), everywhere, whole, None if weights is None else weights[None])[0]
    return trend, seasonal


def robust_weights(resid: np.ndarray, scale: float) -> np.ndarray:
    """Bisquare weights; ``scale`` is six times the median absolute residual."""
    r = np.abs(resid)
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = (1 - (r / scale) ** 2) ** 2
    return np.where(r <= 0.001 * scale, 1.0, np.where(r <= 0.999 * scale, inner, 0.0))


def stl_series(y: np.ndarray, period: int, robust_passes: int = ROBUST_PASSES):
    trend, weights = np.zeros(len(y)), None
    for k in range(robust_passes + 1):
        trend, seasonal = stl_pass(y, trend, weights, period)
        if k < robust_passes:
            resid = y - trend - seasonal
            weights = robust_weights(resid, 6 * np.median(np.abs(resid)))
    return trend, seasonal


# ---- STL on a panel ------------------------------------------------------------------------

def stl(p: Panel, period: int, robust_passes: int = ROBUST_PASSES) -> DataFrame:
    """Adds idx, n, trend, seasonal, resid (null for series shorter than two periods and for series
    with a missing value).

    Series that fit one block are decomposed in one pass per series.  Longer ones are cut into
    blocks with enough border rows for one inner loop; only the residual scale of the
    robustness weights is global, and it comes from the exact distributed median after each pass.
    """
    if p.longest > p.spec.block_rows:
        return _stl_blocks(p, period, robust_passes)
    target, rows = p.spec.target, p.indexed()
    ready = as_micros(rows)
    added = [T.StructField(c, T.DoubleType()) for c in ("trend", "seasonal", "resid")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        y = table[target].to_numpy(zero_copy_only=False).astype(float)
        if len(y) < 2 * period or np.isnan(y).any():
            cols = [pa.nulls(len(y), pa.float64())] * 3
        else:
            trend, seasonal = stl_series(y, period, robust_passes)
            cols = [pa.array(c) for c in (trend, seasonal, y - trend - seasonal)]
        for field, col in zip(added, cols):
            table = table.append_column(field.name, col)
        return table

    return from_micros(ready.groupBy(*p.keys).applyInArrow(run, T.StructType([*ready.schema.fields, *added])), rows)


def block_reach(period: int) -> int:
    """Rows that one inner loop can carry influence: per smoothing pass three cycles, the
    moving means, the low-pass and the trend window."""
    one = 4 * period + period + 2 + lowpass_span(period) // 2 + trend_span(period) // 2
    return INNER_PASSES * (one + 1)


def _stl_blocks(p: Panel, period: int, robust_passes: int) -> DataFrame:
    ready = stage(p.indexed(), "stl-rows")
    y = p.y.cast("double")
    whole = ready.groupBy(*p.keys).agg(F.when(F.every(y.isNotNull() & ~F.isnan(y)), F.max("n")).otherwise(F.lit(0)).alias("__len"))
    reach = block_reach(period)
    kind = as_micros(ready.select(*p.keys)).schema
    schema = T.StructType([*kind.fields, T.StructField("pos", T.LongType()), T.StructField("__len", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("__y", "trend", "seasonal", "resid")]])
    state = p.attach(ready, whole).select(*p.keys, F.col("idx").alias("pos"), "__len", y.alias("__y"), F.lit(0.0).alias("trend"), F.lit(1.0).alias("__w"))
    keys = p.keys

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        y = table["__y"].to_numpy(zero_copy_only=False)
        core = table["__core"].to_numpy(zero_copy_only=False)
        if table["__len"][0].as_py() < 2 * period:
            trend = seasonal = np.full(len(y), np.nan)
        else:
            trend, seasonal = stl_pass(y, table["trend"].to_numpy(zero_copy_only=False), table["__w"].to_numpy(zero_copy_only=False), period,
                                       table["pos"][0].as_py(), table["__len"][0].as_py())
        out = table.select([*keys, "pos", "__len", "__y"])
        for name, col in (("trend", trend), ("seasonal", seasonal), ("resid", y - trend - seasonal)):
            out = out.append_column(name, pa.array(col, from_pandas=True))
        return out.filter(pa.array(core))

    q = p.derive(state, time="pos", tie=(), target="__y")
    for k in range(robust_passes + 1):
        blocks, _ = q.blocked(reach, reach, df=state)
        passed = as_micros(blocks.drop("idx", "n")).groupBy(*keys, "__block").applyInArrow(run, schema)
        parts = stage(from_micros(passed, ready.select(*keys)), "stl-pass")
        if k < robust_passes:
            sized = parts.withColumn("__r", F.abs("resid"))
            mid = order_statistics(q, "__r", {"m": 0.5}, sized).select(*keys, (6 * interpolate("m")).alias("__s"))
            r, s = F.col("__r"), F.col("__s")
            weight = F.when(r <= 0.001 * s, 1.0).when(r <= 0.999 * s, (1 - (r / s) * (r / s)) * (1 - (r / s) * (r / s))).otherwise(0.0)
            state = q.attach(sized, mid, "left").select(*keys, "pos", "__len", "__y", "trend", F.coalesce(weight, F.lit(1.0)).alias("__w"))
    done = parts.select(*keys, F.col("pos").alias("idx"), "trend", "seasonal", "resid")
    return key_join(ready, done, [*keys, "idx"])


def strengths(p: Panel, period: int, method: str = "stl") -> DataFrame:
    """Trend and seasonal strength per series, max(0, 1 - var(r)/var(x + r)), ddof 1."""
    d = (classical if method == "classical" else stl)(p, period)
    r = F.col("resid")
    ratio = lambda c: F.greatest(F.lit(0.0), 1 - F.try_divide(F.var_samp(r), F.var_samp(F.col(c) + r)))
    return d.groupBy(*p.keys).agg(ratio("trend").alias("trend_strength"), ratio("seasonal").alias("seasonal_strength"))


def residual_summary(p: Panel, period: int, method: str = "stl") -> DataFrame:
    """Trend mean, seasonal amplitude, residual std (ddof 1), 3-sigma threshold."""
    d = (classical if method == "classical" else stl)(p, period)
    return d.groupBy(*p.keys).agg(
        F.avg("trend").alias("trend_mean"), (F.max("seasonal") - F.min("seasonal")).alias("seasonal_amplitude"),
        F.stddev_samp("resid").alias("residual_std"), (3 * F.stddev_samp("resid")).alias("anomaly_threshold"))


def seasonal_period(p: Panel, periods=CANDIDATE_PERIODS, strength: float = 0.1, flag: DataFrame | None = None) -> DataFrame:
    """First period with n >= 2 periods whose STL seasonal part explains more than
    ``strength`` of the variance; null without significant autocorrelation or for n <= 20.

    Every (series, period) pair is its own group."""
    from .autocorrelation import seasonality_flag
    target = p.spec.target
    if p.longest <= p.spec.block_rows:
        ready = p.indexed().select(*p.keys, "idx", "n", p.y.cast("double").alias("__y"))
        grid = ready.withColumn("period", F.explode(F.filter(F.array(*[F.lit(x) for x in periods]),
                                                             lambda x: F.col("n") >= 2 * x)))
        schema = T.StructType([*[ready.schema[k] for k in p.keys], T.StructField("period", T.IntegerType()), T.StructField("share", T.DoubleType())])
        keys = p.keys

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("idx")
            y = table["__y"].to_numpy(zero_copy_only=False)
            period = table["period"][0].as_py()
            share = None
            if not np.isnan(y).any() and np.var(y) > 0:
                share = float(np.var(stl_series(y, period)[1]) / np.var(y))
            one = table.select([*keys, "period"]).slice(0, 1)
            return one.append_column("share", pa.array([share], pa.float64()))

        shares = grid.groupBy(*p.keys, "period").applyInArrow(run, schema)
    else:
        one = lambda x: stl(p, x).where(F.col("n") >= 2 * x).groupBy(*p.keys).agg(
            F.try_divide(F.var_pop("seasonal"), F.var_pop(target)).alias("share")).withColumn("period", F.lit(x))
        shares = reduce(DataFrame.unionByName, [one(x) for x in periods if p.longest >= 2 * x])
    best = shares.where(F.col("share") > strength).groupBy(*p.keys).agg(F.min("period").alias("__p"))
    base = p.attach(p.aggregate(F.count(F.lit(1)).alias("__n")), seasonality_flag(p) if flag is None else flag)
    found = p.attach(base, best, "left")
    return found.select(*p.keys, F.when(F.col("has_seasonality") & (F.col("__n") > 20), F.col("__p")).cast("long").alias("seasonal_period"))

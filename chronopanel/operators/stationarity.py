"""Unit-root and level-stationarity tests per series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..shared import stage
from .gram import lag_sums, solve
from .lagged import lagged_gram, level_sums, nested_rss, prefix_sums
from .panel import Panel

# MacKinnon (1994) response surface of the unit-root test with a constant.
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
# Critical points of the level-stationarity statistic.
KPSS_POINTS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def max_lag(n: int) -> int:
    return max(0, min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2))


def unit_root_pvalue(t: float) -> float:
    if t > TAU_MAX:
        return 1.0
    if t < TAU_MIN:
        return 0.0
    coef = TAU_SMALL if t <= TAU_STAR else TAU_LARGE
    z = sum(c * t ** i for i, c in enumerate(coef))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def adf(p: Panel, fixed_lags: int | None = None, most: int | None = None) -> DataFrame:
    """T4: augmented Dickey-Fuller test with a constant; the lag order minimizes AIC on the
    common sample and the statistic uses all rows that order allows.  ``fixed_lags`` sets the
    order instead, ``most`` lowers the greatest order tried.

    All regressions come from the lagged products of the differences and the values at both ends
    (see ``lagged``): numbers linear in the lags leave a block, and the nested orders share one
    elimination.  Rows without a target are left out; a series that does not change on the
    common sample, is shorter than 4 or holds a value that is not finite has no result."""
    choose = fixed_lags is None
    bound = fixed_lags if not choose else most
    limit = lambda n: max_lag(n) if bound is None else min(bound, max_lag(n))
    lags = (0, limit(p.longest))
    points = prefix_sums(p.derive(p.df.where(p.y.isNotNull())), lags)
    fields = T.StructType([*[points.schema[k] for k in p.keys], T.StructField("adf_statistic", T.DoubleType()),
                           T.StructField("adf_pvalue", T.DoubleType()), T.StructField("adf_lags", T.LongType())])
    keys = p.keys

    def run(batches):
        for b in batches:
            rows = [_adf_row(r, lags, limit(int(r.fit_rows)), choose) for r in b.itertuples()]
            out = b[keys].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=["adf_statistic", "adf_pvalue", "adf_lags"])], axis=1)

    return points.mapInPandas(run, fields)


def _adf_gram(r, lags: tuple[int, ...], k: int) -> np.ndarray:
    """Cross products of (dy[t], 1, y[t-1], dy[t-1], .., dy[t-k]) over all rows that k lags allow."""
    n, cells, start = int(r.fit_rows), np.asarray(r.cells, float), k + 1
    head, tail = ((np.asarray(x, float) - r.mean) / r.std for x in (r.head, r.tail))
    c, total, *_ = level_sums(cells, lags, 1)
    steps = lagged_gram(c, total, np.diff(head), np.diff(tail), n - 1, k, k)
    squares, whole = level_sums(cells, lags, 0)[:2]
    g = np.zeros((k + 3, k + 3))
    order = [0, 1, *range(3, k + 3)]
    g[np.ix_(order, order)] = steps
    g[1, 2] = g[2, 1] = whole - head[:start - 1].sum() - tail[-1]
    g[2, 2] = squares[0] - (head[:start - 1] ** 2).sum() - tail[-1] ** 2
    # y[t-1] dy[t-j]: half a difference of squares, carried from y[t-j] to y[t-1] by the steps between
    s = steps[np.ix_([0, *range(2, k + 2)], [0, *range(2, k + 2)])]
    for j in range(k + 1):
        edge = tail[-1 - j] ** 2 - head[start - 1 - j] ** 2
        at = order[j] if j == 0 else 2 + j
        g[2, at] = g[at, 2] = (edge + (s[j, j] if j else -s[0, 0])) / 2 + s[1:j, j].sum()
    return g


def _adf_row(r, lags: tuple[int, ...], top: int, choose: bool):
    n = int(r.fit_rows)
    if n < 4 or not r.std > 0:
        return None, None, None
    best = top
    g = _adf_gram(r, lags, top)
    moves = level_sums(np.asarray(r.cells, float), lags, 1)[0][0]
    if not np.isfinite(g).all() or g[0, 0] <= 1e-13 * moves:
        return None, None, None
    if choose:
        rows = n - 1 - top
        rss = nested_rss(g, 0, list(range(1, top + 3)))[1:]
        best = int(np.argmin(rows * np.log(np.maximum(rss, 1e-300) / rows) + 2 * (2 + np.arange(top + 1))))
        g = _adf_gram(r, lags, best)
    beta, rss, inv = solve(g, 0, list(range(1, 3 + best)))
    freedom = n - 1 - best - (2 + best)
    if freedom <= 0 or rss <= 0:
        return None, None, None
    t = float(beta[1] / math.sqrt(rss / freedom * inv[1, 1]))
    return t, unit_root_pvalue(t), best


def kpss(p: Panel, lags: str = "auto") -> DataFrame:
    """T5: level-stationarity statistic.  The number of Bartlett lags follows the automatic rule
    of Hobijn et al., or with ``lags='short'`` 4*(n/100)^(1/4).  Running sums cross block
    borders through block totals."""
    n = F.col("n").cast("double")
    y = p.y.cast("double")
    base = p.df.select(*p.keys, p.spec.time, *p.spec.tie, y.alias("__y"))
    size = base.groupBy(*p.keys).agg(F.avg("__y").alias("__mean"), F.count(F.lit(1)).alias("n"))
    centred = p.attach(base, size.drop("n")).select(*p.keys, p.spec.time, *p.spec.tie, (F.col("__y") - F.col("__mean")).alias("__e"))
    if lags == "short":
        plan = size.select(*p.keys, "n", F.floor(4 * F.pow(n / 100, F.lit(0.25))).cast("long").alias("kpss_lags"))
        top = int(4 * (p.longest / 100) ** 0.25)
    else:
        first = max(1, int(p.longest ** (2.0 / 9.0) + 1e-9))
        c = p.attach(size, lag_sums(p, centred, "__e", first), cells=first + 1)
        cov = F.floor(F.pow(n, F.lit(2.0 / 9.0)) + 1e-9)
        at = lambda k: F.when(F.lit(k) <= cov, F.get("sums", F.lit(k)) * 2.0 / n).otherwise(0.0)
        s0 = sum((at(k) for k in range(1, first + 1)), F.get("sums", F.lit(0)) / n)
        s1 = sum((at(k) * k for k in range(1, first + 1)), F.lit(0.0))
        shat = F.try_divide(s1, s0)
        auto = F.floor(1.1447 * F.pow(shat * shat, F.lit(1.0 / 3.0)) * F.pow(n, F.lit(1.0 / 3.0)))
        varies = F.get("sums", F.lit(0)) > 0
        plan = stage(c.select(*p.keys, "n", F.coalesce(F.when(varies, F.least(auto, n - 1)), F.lit(0)).cast("long").alias("kpss_lags")), "kpss-lags")
        top = int(plan.agg(F.max("kpss_lags")).first()[0] or 0)
    plan = p.attach(plan, lag_sums(p, centred, "__e", top), cells=top + 1)
    m = F.col("kpss_lags") + 1.0
    weighted = F.transform("sums", lambda v, k: F.when(k == 0, v).when(k <= F.col("kpss_lags"), 2.0 * (1.0 - k / m) * v).otherwise(0.0))
    plan = plan.select(*p.keys, "n", "kpss_lags", F.get("sums", F.lit(0)).alias("c0"),
                       F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v).alias("__spread"))
    d, w = p.blocked(df=centred)
    d = d.withColumn("__s", F.sum("__e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = d.groupBy(*p.keys, "__block").agg(
        F.count(F.lit(1)).alias("m"), F.sum("__e").alias("total"), F.sum("__s").alias("s1"), F.sum(F.col("__s") * F.col("__s")).alias("s2"))
    along = Window.partitionBy(*p.keys).orderBy("__block")
    blocks = blocks.withColumn("off", F.sum("total").over(along) - F.col("total"))
    eta = blocks.groupBy(*p.keys).agg(F.sum(F.col("s2") + 2 * F.col("off") * F.col("s1") + F.col("m") * F.col("off") * F.col("off")).alias("__eta"))
    stat = F.try_divide(F.col("__eta") / n, F.col("__spread"))
    out = p.attach(plan, eta).withColumn("kpss_statistic", F.when(F.col("c0") > 0, stat))
    return out.select(*p.keys, "kpss_statistic", kpss_pvalue(F.col("kpss_statistic")).alias("kpss_pvalue"), "kpss_lags")


def kpss_pvalue(s):
    """Linear interpolation in the table, clamped to [0.01, 0.10]."""
    p = F.when(s <= KPSS_POINTS[0][0], F.lit(KPSS_POINTS[0][1]))
    for (a, pa_), (b, pb) in zip(KPSS_POINTS, KPSS_POINTS[1:]):
        p = p.when(s <= b, F.lit(pa_) + (s - a) * ((pb - pa_) / (b - a)))
    return p.when(s.isNotNull(), F.lit(KPSS_POINTS[-1][1]))

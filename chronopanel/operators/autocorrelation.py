"""Autocorrelation, lags, rolling statistics and other ordered statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import correlation, present
from .panel import Panel
from .quantiles import quantiles

ACF_MAX_LAG = 50
EXPLAIN_LAGS = (1, 6, 12, 24)



def acf(p: Panel, max_lag: int = ACF_MAX_LAG) -> DataFrame:
    """Biased autocorrelation for lags 0..min(max_lag, n/2): (keys, n, lag, acf).

    The lagged products of each block are numpy dot products of one Arrow column; Spark adds
    them up per series."""
    from .gram import lag_sums
    base = p.df.select(*p.keys, p.spec.time, *p.spec.tie, p.y.cast("double").alias("__y"))
    size = base.groupBy(*p.keys).agg(F.avg("__y").alias("__mean"), F.count(F.lit(1)).alias("n"))
    centred = p.attach(base, size).select(*p.keys, p.spec.time, *p.spec.tie, (F.col("__y") - F.col("__mean")).alias("__e"))
    c = p.attach(size, lag_sums(p, centred, "__e", min(max_lag, max(1, p.longest // 2))), cells=max_lag + 1)
    out = c.select(*p.keys, "n", F.get("sums", F.lit(0)).alias("__c0"), F.posexplode("sums").alias("lag", "__c"))
    value = F.when(F.col("lag") == 0, 1.0).when(F.col("__c0") > 0, F.col("__c") / F.col("__c0"))
    return out.where(F.col("lag") <= F.floor(F.col("n") / 2)).select(*p.keys, "n", F.col("lag").cast("long").alias("lag"), value.alias("acf"))


def significant_lags(p: Panel, max_lag: int = ACF_MAX_LAG) -> DataFrame:
    """Lags whose |acf| exceeds 2/sqrt(n)."""
    return acf(p, max_lag).where((F.col("lag") > 0) & (F.abs("acf") > 2 / F.sqrt("n")))


def seasonality_flag(p: Panel, max_lag: int = ACF_MAX_LAG) -> DataFrame:
    a = acf(p, max_lag)
    hit = (F.col("lag") > 0) & (F.abs("acf") > 2 / F.sqrt("n"))
    return a.groupBy(*p.keys).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("has_seasonality"))


def lag_correlations(p: Panel, lags=EXPLAIN_LAGS) -> DataFrame:
    """Pearson correlation with the series ``lag`` rows earlier (NaN -> 0) and the value
    ``lag`` rows from the end, for lags shorter than the series."""
    y = p.y.cast("double")
    d = p.over(lambda w: {f"__l{k}": F.lag(y, k).over(w) for k in lags}, before=max(lags))
    got = d.groupBy(*p.keys).agg(F.max("n").alias("n"), *[
        e for k in lags for e in (correlation(y, F.col(f"__l{k}")).alias(f"__c{k}"),
                                  F.max(F.when(F.col("idx") == F.col("n") - k, y)).alias(f"__v{k}"))])
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"__c{k}").alias("correlation"),
                              F.col(f"__v{k}").alias("value")) for k in lags])
    return got.select(*p.keys, "n", F.explode(rows).alias("__i")).where(F.col("n") > F.col("__i.lag")).select(*p.keys, "__i.*")


def lag_hints(corr: DataFrame) -> DataFrame:
    """A reading of the lag-1, lag-12 and lag-24 correlations."""
    c, lag = F.col("correlation"), F.col("lag")
    hint = (F.when((lag == 1) & (c < -0.1), "mean-reverting").when((lag == 1) & (c > 0.3), "persistent")
            .when(lag == 1, "weak short-term dependence")
            .when(lag.isin(12, 24) & (F.abs(c) < 0.1), "weak seasonality")
            .when(lag.isin(12, 24) & (c > 0.3), "strong seasonal signal"))
    return corr.withColumn("hint", hint).where(F.col("hint").isNotNull())


def rolling(p: Panel, window: int = 24, df: DataFrame | None = None) -> DataFrame:
    """Trailing mean and std (ddof 1) over ``window`` rows, the current one included."""
    y = p.y.cast("double")
    frame = lambda w: w.rowsBetween(-(window - 1), 0)
    return p.over(lambda w: {"rolling_mean": F.avg(y).over(frame(w)), "rolling_std": F.stddev_samp(y).over(frame(w))},
                  before=window - 1, df=df)


def lag_matrix(p: Panel, n_lags: int, df: DataFrame | None = None) -> DataFrame:
    """Columns lag_1..lag_n with lag_k = the value k rows earlier; rows without a full
    history are dropped.  Features stay beside the lags (J1)."""
    y = p.y.cast("double")
    d = p.over(lambda w: {f"lag_{k}": F.lag(y, k).over(w) for k in range(1, n_lags + 1)}, before=n_lags, df=df)
    return d.where(F.col("idx") >= n_lags)


def statistical_summary(p: Panel, steps_per_day: int = 24, fraction: float = 0.8) -> DataFrame:
    """Train (first 80 %) and test statistics, last day/week means, recent direction."""
    from .prep import split
    d = split(p, fraction)
    y, train = p.y.cast("double"), F.col("is_train")
    n_train = F.floor(F.col("n") * F.lit(fraction))
    back = n_train - 1 - F.col("idx")  # 0 = last training row
    part = lambda lo, hi: F.avg(F.when(train & (back >= lo) & (back < hi), y))
    day, week = steps_per_day, steps_per_day * 7
    tr, te = F.when(train, y), F.when(~train, y)
    got = d.groupBy(*p.keys).agg(
        F.count(tr).alias("n_train"), F.count(te).alias("n_test"),
        F.avg(tr).alias("train_mean"), F.stddev_samp(tr).alias("train_std"), F.min(tr).alias("train_min"), F.max(tr).alias("train_max"),
        F.avg(te).alias("test_mean"), F.stddev_samp(te).alias("test_std"),
        part(0, day).alias("__d1"), part(day, 2 * day).alias("__d2"), part(0, week).alias("__w"))
    n = F.col("n_train")
    return got.select(
        *p.keys, "n_train", "n_test", "train_mean", "train_std", "train_min", "train_max", "test_mean", "test_std",
        F.when(n < 2 * day, "stable").when(F.col("__d1") > F.col("__d2"), "upward").otherwise("downward").alias("recent_trend"),
        F.when(n > week, F.col("__w")).otherwise(F.col("train_mean")).alias("recent_7d_avg"),
        F.when(n > day, F.col("__d1")).otherwise(F.col("train_mean")).alias("recent_1d_avg"))


def context_windows(p: Panel, reach: int = 2, df: DataFrame | None = None) -> DataFrame:
    """The rows within ``reach`` of each row, as arrays of target and feature values."""
    cols = [p.spec.target, *p.spec.features]
    frame = lambda w: w.rowsBetween(-reach, reach)
    return p.over(lambda w: {f"{c}_window": F.collect_list(F.coalesce(F.round(F.col(c).cast("double"), 3), F.lit(float("nan")))).over(frame(w))
                             for c in cols}, before=reach, after=reach, df=df)


def percentile_ranks(p: Panel, picked: DataFrame, limit: int = 5) -> DataFrame:
    """Percentile rank of up to ``limit`` values per series, with p95 and p99.

    ``picked`` holds (keys, rank_no 1..limit, value).  The few values travel as an array beside
    the rows, so the series is aggregated once and never multiplied."""
    vals = picked.where(F.col("rank_no") <= limit).groupBy(*p.keys).agg(
        *[F.max(F.when(F.col("rank_no") == i, F.col("value"))).alias(f"__v{i}") for i in range(1, limit + 1)])
    y = F.col("__y")
    rows = p.attach(p.df.where(present(p.y)).select(*p.keys, p.y.cast("double").alias("__y")), vals)
    got = rows.groupBy(*p.keys).agg(F.count(F.lit(1)).alias("n"), *[
        e for i in range(1, limit + 1) for e in (
            F.min(f"__v{i}").alias(f"__v{i}"),
            F.sum((y < F.col(f"__v{i}")).cast("long")).alias(f"__lt{i}"),
            F.sum((y <= F.col(f"__v{i}")).cast("long")).alias(f"__le{i}"))])
    item = lambda i: F.struct(
        F.lit(i).cast("long").alias("rank_no"), F.col(f"__v{i}").alias("value"),
        ((F.col(f"__lt{i}") + F.col(f"__le{i}") + (F.col(f"__le{i}") > F.col(f"__lt{i}")).cast("long")) * 50.0 / F.col("n")).alias("percentile"))
    out = got.select(*p.keys, F.explode(F.array(*[item(i) for i in range(1, limit + 1)])).alias("__i")).select(*p.keys, "__i.*")
    tails = quantiles(p, p.spec.target, {"p95": 0.95, "p99": 0.99})
    return p.attach(out.where(F.col("value").isNotNull()), tails)

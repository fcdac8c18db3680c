"""Folds, metrics, rolling-origin evaluation and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import is_finite
from ..shared import BROADCAST_ROWS, key_join, stage_union
from .panel import Panel

CV_FOLDS = 3
MIN_TRAIN = 50
MAX_WINDOWS = 50


def folds(p: Panel, horizon: int, n_folds: int = CV_FOLDS, short: bool = True, align: str = "start") -> DataFrame:
    """V1/V2: expanding folds (keys, fold, origin, fold_h): train is idx < origin, test the next
    ``fold_h`` rows.  ``short``: a series too short for a fold gets one split near its end.
    ``align='end'`` moves the folds so that the last one ends at the last row."""
    least = max(MIN_TRAIN, 2 * horizon)
    n = F.col("n")
    sizes = p.aggregate(F.count(F.lit(1)).alias("n"))
    step = F.greatest(F.lit(1), F.floor((n - least - horizon) / n_folds))
    shift = (n - horizon - (least + step * (n_folds - 1))) if align == "end" else F.lit(0)
    out = sizes.select(*p.keys, "n", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    enough = n >= least + horizon
    origin = F.when(enough, least + F.col("fold") * step + F.greatest(shift, F.lit(0)))
    if short:
        origin = origin.when(F.col("fold") == 0, F.greatest(F.lit(1), n - horizon))
    out = out.select(*p.keys, F.col("fold").cast("long").alias("fold"), origin.cast("long").alias("origin"), "n")
    fits = F.when(enough, F.col("origin") + horizon <= n).otherwise(F.col("origin") < n)
    return out.where(F.col("origin").isNotNull() & fits).select(
        *p.keys, "fold", "origin", F.least(F.lit(horizon), n - F.col("origin")).cast("long").alias("fold_h"))


def evaluation_origins(p: Panel, horizon: int, fraction: float = 0.8, max_windows: int | None = MAX_WINDOWS) -> DataFrame:
    """V7/K6: origins in the last part of each series, stride = horizon, at most ``max_windows``
    (None: all) evenly spaced ones: (keys, window, origin)."""
    n = F.col("n")
    sizes = p.aggregate(F.count(F.lit(1)).alias("n")).withColumn("__train", F.floor(n * F.lit(fraction)))
    total = F.floor((n - F.col("__train") - horizon) / horizon) + 1
    sizes = sizes.withColumn("__total", total).where(F.col("__total") >= 1)
    count = (F.col("__total") if max_windows is None else F.least(F.col("__total"), F.lit(max_windows))).cast("int")
    out = sizes.withColumn("window", F.explode(F.sequence(F.lit(0), count - 1)))
    place = F.col("window")
    if max_windows is not None:
        place = F.when(F.col("__total") > max_windows, F.floor(F.col("window") * (F.col("__total") - 1) / max(max_windows - 1, 1))).otherwise(place)
    return out.select(*p.keys, F.col("window").cast("long").alias("window"),
                      (F.col("__train") + place * horizon).cast("long").alias("origin"))


def _bounded(p: Panel, small: DataFrame, per_series: int) -> DataFrame:
    """Broadcast a table of at most ``per_series`` rows a series only if it is small."""
    return F.broadcast(small) if p.n_series * per_series <= BROADCAST_ROWS else small


def origin_panel(p: Panel, origins: DataFrame, context: int | None = None, n_origins: int = MAX_WINDOWS) -> Panel:
    """One series per (series, origin), holding the rows before the origin (the last ``context``
    ones): every forecaster then fits all origins as one panel.

    With a context the wanted positions are generated and equi-joined on (keys, idx), so the
    work is origins x context whatever the length of the series."""
    rows = p.indexed()
    if context is not None:
        want = origins.select(*p.keys, "origin", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("origin") - context), F.col("origin") - 1)).alias("idx"))
        rows = key_join(rows, _bounded(p, want, n_origins * context), [*p.keys, "idx"])
    else:
        listed = origins.groupBy(*p.keys).agg(F.collect_list("origin").alias("__origins"))
        rows = p.attach(rows, listed)
        rows = rows.withColumn("origin", F.explode(F.filter("__origins", lambda o: F.col("idx") < o))).drop("__origins")
    rows = rows.drop("idx", "n")
    spec = type(p.spec)(**{**p.spec.__dict__, "keys": (*p.spec.keys, "origin")})
    longest = p.longest if context is None else min(context, p.longest)
    return Panel(rows, spec, (p.n_series * n_origins, longest))


def at_origins(p: Panel, fn, origins: DataFrame, horizon: int, params: dict, context: int | None, n_origins: int) -> DataFrame:
    """Forecasts (keys, origin, h, yhat, ...) refitted at every origin.  A forecaster on whole
    histories that has an ``at_origins`` of its own fits all origins from one pass over the rows;
    any other gets one series per origin.  So do series with missing targets, whose rows it would leave out."""
    own = getattr(fn, "at_origins", None)
    if own is not None and context is None and n_origins is not None and p.df.where(p.y.isNull()).isEmpty():
        return own(p, origins, horizon, n_origins, **params)
    return fn(origin_panel(p, origins, context, n_origins), horizon, **params)


def with_actuals(p: Panel, forecasts: DataFrame) -> DataFrame:
    """Forecasts (keys, origin, h, yhat, ...) beside the observed value ``y`` of row
    origin + h - 1; steps past the end drop out.  Equi-join on (keys, idx)."""
    seen = p.indexed().select(*p.keys, "idx", p.y.cast("double").alias("y"))
    f = forecasts.withColumn("idx", (F.col("origin") + F.col("h") - 1).cast("long"))
    return key_join(f, seen, [*p.keys, "idx"])


def metric_columns(y: str = "y", yhat: str = "yhat") -> dict[str, Column]:
    """V3/V4 aggregates: MAPE (zero actuals left out; null if none is left), MAE, RMSE, SMAPE
    (zero denominators left out; 0 if none is left)."""
    a, f = F.col(y), F.col(yhat)
    size = F.abs(a) + F.abs(f)
    return {"mape": F.avg(F.when(a != 0, F.abs((a - f) / a))) * 100,
            "mae": F.avg(F.abs(a - f)),
            "rmse": F.sqrt(F.avg((a - f) * (a - f))),
            "smape": F.coalesce(F.avg(F.when(size > 0, 2.0 * F.abs(a - f) / size)) * 100, F.lit(0.0))}


def score(pairs: DataFrame, by, metrics=("mape", "mae", "rmse", "smape")) -> DataFrame:
    cols = metric_columns()
    return pairs.groupBy(*by).agg(*[cols[m].alias(m) for m in metrics])


def mase_scale(p: Panel, season: int, fraction: float = 0.8) -> DataFrame:
    """Mean absolute seasonal-naive error on the training part; below 1e-9 it counts as 1."""
    y = p.y.cast("double")
    d = p.over(lambda w: {"__d": F.abs(y - F.lag(y, season).over(w))}, before=season)
    scale = F.avg(F.when(F.col("idx") < F.floor(F.col("n") * F.lit(fraction)), F.col("__d")))
    got = d.groupBy(*p.keys).agg(scale.alias("__s"))
    return got.select(*p.keys, F.when(F.col("__s") >= 1e-9, F.col("__s")).otherwise(1.0).alias("scale"))


def add_mase(p: Panel, scored: DataFrame, season: int, fraction: float = 0.8) -> DataFrame:
    out = p.attach(scored, mase_scale(p, season, fraction))
    return out.withColumn("mase", F.col("mae") / F.col("scale")).drop("scale")


def cross_validate(p: Panel, forecaster, horizon: int, params: dict | None = None, n_folds: int = CV_FOLDS,
                   context: int | None = None, short: bool = True, align: str = "start") -> DataFrame:
    """Score one parameter set on every fold: (keys, fold, mape, ...)."""
    f = folds(p, horizon, n_folds, short, align)
    made = at_origins(p, forecaster, f, horizon, params or {}, context, n_folds)
    made = key_join(made, _bounded(p, f, n_folds), [*p.keys, "origin"]).where(F.col("h") <= F.col("fold_h"))
    return score(with_actuals(p, made), [*p.keys, "fold"])


def summarize_folds(scores: DataFrame, by, metric: str = "mape") -> DataFrame:
    """Mean and std (ddof 0; 0 for a single fold) of the finite fold scores."""
    v = F.when(is_finite(F.col(metric)), F.col(metric))
    return scores.groupBy(*by).agg(F.avg(v).alias(f"mean_{metric}"),
                                   F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias(f"std_{metric}"), F.count(v).alias("n_folds"))


def pick_best(summary: DataFrame, by, order: str = "mean_mape", name: str = "params_id") -> DataFrame:
    """V5: the lowest score wins, the earlier candidate on ties; no score at all loses."""
    w = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last(), name)
    return summary.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def rolling_origin(p: Panel, forecasters: dict, horizon: int, fraction: float = 0.8, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """V7: refit every forecaster at every origin: (keys, model, origin, h, y, yhat).
    ``forecasters``: name -> (function, params, context)."""
    origins = evaluation_origins(p, horizon, fraction, max_windows)
    parts = []
    for name, (fn, params, context) in forecasters.items():
        made = at_origins(p, fn, origins, horizon, params, context, max_windows)
        parts.append(made.select(*p.keys, F.lit(name).alias("model"), "origin", "h", "yhat"))
    return with_actuals(p, stage_union(parts, "rolling"))


def leaderboard(results: DataFrame, by=("horizon", "model"), metrics=("mae", "rmse", "smape", "mase")) -> DataFrame:
    """V8: mean metrics per group."""
    return results.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def best_per_group(results: DataFrame, by=("dataset", "horizon"), metric: str = "mae") -> DataFrame:
    """K7: the best model of every group."""
    w = Window.partitionBy(*by).orderBy(F.col(metric).asc_nulls_last(), "model")
    return results.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")

"""The model registry, parameter grids and grid search."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import key_join, stage, stage_union
from . import arima as _arima, mlp as _mlp, naive as _naive, smoothing as _smoothing, trees as _trees
from .panel import Panel
from .validation import cross_validate, folds, origin_panel, pick_best, score, summarize_folds, with_actuals

MAX_COMBINATIONS = 10


@dataclass(frozen=True)
class Forecaster:
    """``series``: fits every series by itself: (panel, horizon, **params) -> forecasts.
    ``pooled``: (fit, forecast) of one model over all series.  ``features``: the pooled fit on
    the covariates of the same row, where the model has one."""

    name: str
    family: str
    defaults: dict = field(default_factory=dict)
    grid: dict = field(default_factory=dict)
    series: Callable | None = None
    pooled: tuple[Callable, Callable] | None = None
    features: Callable | None = None
    context: int | None = None

    @property
    def multivariate(self) -> bool:
        return self.features is not None


def _lag_trees(kind):
    fit = lambda p, **params: _trees.fit_lag_trees(p, kind, **params)
    return fit, _trees.forecast_lag_trees


def _network_fit(p, **params):
    return _mlp.fit_mlp(p, **{k: params[k] for k in ("n_lags", "hidden_size", "epochs", "learning_rate") if k in params})


# Families, default parameters and search grids.
MODELS: dict[str, Forecaster] = {m.name: m for m in (
    Forecaster("Naive", "statistical", series=_naive.naive, context=1),
    Forecaster("SeasonalNaive", "statistical", {"seasonal_period": 12}, {"seasonal_period": [7, 12, 24, 30]},
               series=_naive.seasonal_naive, context=30),
    Forecaster("ARIMA", "statistical", series=_arima.arima),
    Forecaster("ETS", "statistical", {"trend": "add", "seasonal": "add", "seasonal_periods": 12},
               {"trend": ["add", "mul", "none"], "seasonal": ["add", "mul", "none"]}, series=_smoothing.ets),
    Forecaster("RandomForest", "tree", {"n_estimators": 100, "max_depth": 10, "n_lags": 12},
               {"n_estimators": [50, 100, 200], "max_depth": [5, 10, 15], "n_lags": [6, 12, 24]}, pooled=_lag_trees("forest"),
               features=lambda p, **q: _trees.fit_feature_trees(p, "forest", **{k: v for k, v in q.items() if k != "n_lags"})),
    Forecaster("Boosted", "tree", {"num_leaves": 31, "learning_rate": 0.1, "n_estimators": 100, "n_lags": 12},
               {"num_leaves": [15, 31, 63], "learning_rate": [0.01, 0.1, 0.3], "n_estimators": [50, 100, 200], "n_lags": [6, 12, 24]},
               pooled=_lag_trees("boosted"),
               features=lambda p, **q: _trees.fit_feature_trees(p, "boosted", **{k: v for k, v in q.items() if k != "n_lags"})),
    Forecaster("Network", "neural", {"n_lags": 24, "hidden_size": 64, "epochs": 50, "learning_rate": 0.001},
               {"n_lags": [12, 24, 48], "hidden_size": [32, 64, 128], "epochs": [30, 50, 100]}, pooled=(_network_fit, _mlp.forecast_mlp)),
)}


def register_model(model: Forecaster) -> None:
    MODELS[model.name] = model


def families() -> dict[str, str]:
    return {m.name: m.family for m in MODELS.values()}


def combinations(spark: SparkSession, grid: dict, limit: int | None = MAX_COMBINATIONS) -> list[dict]:
    """K5: all combinations; above ``limit`` (None: no limit) the first ones in hash order (deterministic)."""
    if not grid:
        return []
    names = list(grid)
    df = spark.range(1)
    for n in names:
        df = df.withColumn(n, F.explode(F.array(*[F.lit(v) for v in grid[n]])))
    df = df.drop("id")
    if limit is not None and len(list(product(*grid.values()))) > limit:
        df = df.orderBy(F.xxhash64(*names)).limit(limit)
    return [r.asDict() for r in df.collect()]  # a grid: a few values per parameter


def candidates(spark: SparkSession, model: Forecaster, limit: int | None = None) -> list[dict]:
    """The whole grid unless a ``limit`` is given; the defaults where there is none."""
    return combinations(spark, model.grid, limit) or [dict(model.defaults)]


def _context(model: Forecaster, params: dict) -> int | None:
    """Rows of history a fit needs (None: all)."""
    return None if model.context is None else max(model.context, params.get("seasonal_period", 0), params.get("context", 0))


def search(p: Panel, model: Forecaster, horizon: int, params: list[dict] | None = None, n_folds: int = 3) -> DataFrame:
    """V5: fold scores of all candidates: (params_id, keys, fold, mape, ...).

    All combinations of the grid unless ``params`` are given.  Models fitted per series: one job a
    candidate, for all series and folds.  Pooled models: one fit per candidate and fold, a few at a time."""
    params = params or candidates(p.df.sparkSession, model)
    if model.series is not None:
        one = lambda i, q: cross_validate(p, model.series, horizon, q, n_folds, _context(model, q)).withColumn("params_id", F.lit(i))
        return stage_union([one(i, q) for i, q in enumerate(params)], "cv")
    multivariate = bool(p.spec.features) and model.multivariate
    f = stage(folds(p, horizon, n_folds, short=not multivariate), "folds")
    ready = p.derive(stage(p.indexed(), "cv-rows"))

    def run(task):
        i, q, fold = task
        scored = _pooled_fold(ready, model, horizon, q, f.where(F.col("fold") == fold), multivariate)
        return stage(scored.withColumn("params_id", F.lit(i)).withColumn("fold", F.lit(fold).cast("long")), "cv")

    tasks = [(i, q, k) for i, q in enumerate(params) for k in range(n_folds)]
    # a fit on few rows keeps one core busy
    with ThreadPoolExecutor(8) as pool:
        parts = list(pool.map(run, tasks))
    return reduce(DataFrame.unionByName, parts)


def _pooled_fold(p: Panel, model: Forecaster, horizon: int, params: dict, fold: DataFrame, multivariate: bool) -> DataFrame:
    """``p`` holds ``idx``; train on the rows before each series' origin, test after it."""
    at = fold.select(*p.keys, "origin", "fold_h")
    rows = p.attach(p.df, at)
    train = p.derive(rows.where(F.col("idx") < F.col("origin")).drop("idx", "n", "origin", "fold_h"))
    if multivariate:
        fitted = model.features(train, **params)
        test = rows.where((F.col("idx") >= F.col("origin")) & (F.col("idx") < F.col("origin") + F.col("fold_h")))
        pairs = _trees.predict_features(fitted, test).withColumn("y", p.y.cast("double"))
        return score(pairs, p.keys)
    fit, forecast = model.pooled
    fitted = fit(train, **params)
    made = p.attach(forecast(train, fitted, horizon), at).where(F.col("h") <= F.col("fold_h"))
    return score(with_actuals(p.derive(p.df.drop("idx", "n")), made), p.keys)


def train_and_forecast(p: Panel, name: str, horizon: int, future: DataFrame | None = None, params: list[dict] | None = None,
                       n_folds: int = 3) -> dict:
    """Search, refit on all rows (V6) and forecast.

    Returns ``forecasts`` (keys, model, h, yhat, fallback), ``scores`` (keys, model, mean_mape,
    std_mape, n_folds, params_id), ``params``, ``fitted`` (pooled models) and ``seconds``.
    Covariate models (M15) are used when the panel has features and the model supports them;
    they forecast on the caller's ``future`` rows (keys, h, features)."""
    start = time.time()
    model = MODELS[name]
    params = params or candidates(p.df.sparkSession, model)
    scores = search(p, model, horizon, params, n_folds)
    multivariate = bool(p.spec.features) and model.multivariate
    if model.series is not None:
        best = pick_best(summarize_folds(scores, [*p.keys, "params_id"]), p.keys)
        best = stage(best, "best")
        parts = []
        for i, q in enumerate(params):
            mine = p.derive(key_join(p.df, best.where(F.col("params_id") == i).select(*p.keys, F.lit(True).alias("__mine")), p.keys).drop("__mine")) \
                if len(params) > 1 else p
            parts.append(model.series(mine, horizon, **q))
        made, fitted, chosen = stage_union(parts, "forecasts"), None, params
    else:
        overall = summarize_folds(scores, ["params_id"])
        first = overall.orderBy(F.col("mean_mape").asc_nulls_last(), "params_id").first()
        i = int(first["params_id"]) if first else 0
        best = summarize_folds(scores.where(F.col("params_id") == i), [*p.keys, "params_id"])
        chosen = params[i]
        if multivariate:
            fitted = model.features(p, **chosen)
            if future is None:
                from .whatif import future_features
                future = future_features(p, horizon)
            made = _trees.predict_features(fitted, future).select(*p.keys, "h", "yhat", F.lit(False).alias("fallback"))
        else:
            fit, forecast = model.pooled
            fitted = fit(p, **chosen)
            made = forecast(p, fitted, horizon)
    tag = F.lit(name).alias("model")
    return {"forecasts": made.select(*p.keys, tag, "h", "yhat", "fallback"), "scores": best.select(*p.keys, tag, "mean_mape", "std_mape", "n_folds", "params_id"),
            "params": chosen, "fitted": fitted, "multivariate": multivariate, "seconds": time.time() - start}

"""Stacking: out-of-fold one-step predictions of three base models and a meta-learner."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, functions as F

from ..shared import key_join, stage, stage_union
from . import mlp as _mlp, trees as _trees
from .panel import Panel
from .validation import origin_panel, with_actuals

STACK_FOLDS = 8
MIN_STACK_TRAIN = 200
BASE_MODELS = ("Network", "Boosted_uni", "RF_combined")
META_COLUMNS = ("base_network", "base_boosted", "base_forest", "last_value")


def stack_origins(p: Panel, horizon: int, n_folds: int = STACK_FOLDS, least: int | None = None) -> DataFrame:
    """Origins from max(200, 3h) in steps of max(h, (n - min - h) // folds): (keys, fold, origin)."""
    first = max(MIN_STACK_TRAIN, 3 * horizon) if least is None else least
    n = F.col("n")
    sizes = p.aggregate(F.count(F.lit(1)).alias("n")).where(n >= first + horizon)
    step = F.greatest(F.lit(horizon), F.floor((n - first - horizon) / n_folds))
    out = sizes.select(*p.keys, F.posexplode(F.sequence(F.lit(first).cast("long"), (n - horizon).cast("long"), step.cast("long"))).alias("fold", "origin"))
    return out.select(*p.keys, F.col("fold").cast("long").alias("fold"), "origin")


def base_fits(p: Panel, params: dict | None = None) -> dict:
    """The three base models, each one pooled fit on the panel's rows."""
    q = params or {}
    return {"Network": _mlp.fit_mlp(p, **q.get("Network", {})),
            "Boosted_uni": _trees.fit_lag_trees(p, "boosted", **q.get("Boosted_uni", {})),
            "RF_combined": _trees.fit_lag_trees(p, "forest", exog=p.spec.features, **q.get("RF_combined", {}))}


def base_forecasts(p: Panel, fits: dict, origins: DataFrame, horizon: int, n_origins: int) -> DataFrame:
    """Forecasts of the base models from every origin: (keys, origin, h, base_*, last_value)."""
    lags = max(f.n_lags for f in fits.values())
    at = origin_panel(p, origins, lags, n_origins).staged("stack-at")
    ix = p.indexed().select(*p.keys, "idx", *p.spec.features)
    want = origins.select(*p.keys, "origin", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")) \
                  .withColumn("idx", (F.col("origin") + F.col("h") - 1).cast("long"))
    future = key_join(want, ix, [*p.keys, "idx"]).drop("idx")
    made = {"Network": _mlp.forecast_mlp(at, fits["Network"], horizon), "Boosted_uni": _trees.forecast_lag_trees(at, fits["Boosted_uni"], horizon),
            "RF_combined": _trees.forecast_lag_trees(at, fits["RF_combined"], horizon, future)}
    long = stage_union([d.select(*p.keys, "origin", "h", F.lit(m).alias("model"), "yhat") for m, d in made.items()], "stack-made")
    wide = long.groupBy(*p.keys, "origin", "h").pivot("model", list(BASE_MODELS)).agg(F.first("yhat"))
    wide = wide.select(*p.keys, "origin", "h", *[F.col(m).alias(c) for m, c in zip(BASE_MODELS, META_COLUMNS)])
    seen = p.indexed().select(*p.keys, (F.col("idx") + 1).alias("origin"), p.y.cast("double").alias("last_value"))
    return key_join(wide, seen, [*p.keys, "origin"])


def meta_features(p: Panel, horizon: int, params: dict | None = None, n_folds: int = STACK_FOLDS, least: int | None = None) -> DataFrame:
    """V9: (keys, fold, origin, base_*, last_value, y): every fold's models are fitted on the rows
    before its origins and predict one step; ``last_value`` is the value before the origin.
    A few folds are fitted at a time."""
    origins = stage(stack_origins(p, horizon, n_folds, least), "stack-origins")
    top = origins.agg(F.max("fold")).first()[0]
    rows = stage(p.indexed(), "stack-rows")

    def run(k):
        at = origins.where(F.col("fold") == k)
        before = p.attach(rows, at.select(*p.keys, "origin")).where(F.col("idx") < F.col("origin"))
        train = p.derive(before.drop("idx", "n", "origin"))
        fits = base_fits(train, params)
        whole = p.derive(rows.drop("idx", "n"))
        made = base_forecasts(whole, fits, at.select(*p.keys, "origin"), 1, 1)
        return stage(with_actuals(whole, made).withColumn("fold", F.lit(k).cast("long")).drop("h", "idx"), "meta")

    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(run, range(0 if top is None else int(top) + 1)))
    return reduce(DataFrame.unionByName, parts)


def _assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(META_COLUMNS), outputCol="__x", handleInvalid="keep").transform(df)


class MetaLearner:
    """V10 ridge (alpha 1) or V11 boosted (4 leaves, rate 0.02, 50 rounds) on the meta-features;
    with too few samples the mean of the columns, marked in ``fallback``."""

    def __init__(self, kind: str = "ridge", alpha: float = 1.0):
        self.kind, self.alpha, self.model = kind, alpha, None

    def fit(self, meta: DataFrame) -> "MetaLearner":
        n = meta.count()
        if n < (5 if self.kind == "ridge" else 10):
            return self
        data = _assemble(meta)
        if self.kind == "ridge":
            est = LinearRegression(featuresCol="__x", labelCol="y", regParam=self.alpha / n, elasticNetParam=0.0, standardization=False, solver="normal")
        else:
            est = GBTRegressor(featuresCol="__x", labelCol="y", maxDepth=2, stepSize=0.02, maxIter=50, minInstancesPerNode=10, seed=42)
        self.model = est.fit(data)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            return df.withColumn("yhat", sum((F.col(c) for c in META_COLUMNS), F.lit(0.0)) / len(META_COLUMNS)).withColumn("fallback", F.lit(True))
        return self.model.transform(_assemble(df)).withColumnRenamed("prediction", "yhat").drop("__x").withColumn("fallback", F.lit(False))


def evaluate_stacking(p: Panel, horizon: int, params: dict | None = None, fraction: float = 0.8, n_folds: int = STACK_FOLDS,
                      least: int | None = None, max_windows: int = 50) -> DataFrame:
    """Base models, blends and both meta-learners on the held-out windows:
    (keys, model, origin, h, y, yhat, fallback)."""
    from . import blend
    from .explain import train_part
    from .validation import evaluation_origins, score
    train = train_part(p, fraction).staged("stack-train")
    meta = meta_features(train, horizon, params, n_folds, least)
    fits = base_fits(train, params)
    origins = stage(evaluation_origins(p, horizon, fraction, max_windows), "origins")
    wide = stage(with_actuals(p, base_forecasts(p, fits, origins, horizon, max_windows)).drop("idx"), "stack-base")
    by = [*p.keys, "origin", "h", "y"]
    base = wide.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("yhat"))
                                               for m, c in zip(BASE_MODELS, META_COLUMNS)])).alias("__i")).select(*by, "__i.*")
    # blends are weighted by the out-of-fold error, never by the held-out windows
    oof = meta.select(*p.keys, "y", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("yhat"))
                                                       for m, c in zip(BASE_MODELS, META_COLUMNS)])).alias("__i")).select(*p.keys, "y", "__i.*")
    smape = score(oof, [*p.keys, "model"], ("smape",)).withColumnRenamed("smape", "score")
    smape = stage(smape, "stack-smape")
    k2 = [*p.keys, "origin"]
    f = base.select(*k2, "model", "h", "yhat")
    spread = key_join(f.select(*k2, "model").distinct(), smape, [*p.keys, "model"])
    blends = {"Ens_InvSMAPE": blend.combine(f, blend.floored_inverse(spread, k2, n=None), k2), "Ens_Best": blend.best_model(f, spread, k2).drop("model"),
              "Ens_Median": blend.median(f, k2), "Ens_TrimMean": blend.trimmed_mean(f, spread, k2)}
    seen = wide.select(*by)
    made = F.lit(False).alias("fallback")
    parts = [base.select(*p.keys, "model", "origin", "h", "y", "yhat", made)]
    for name, d in blends.items():
        parts.append(key_join(seen, d, [*k2, "h"]).select(*p.keys, F.lit(name).alias("model"), "origin", "h", "y", "yhat", made))
    for name, kind in (("Stack_Ridge", "ridge"), ("Stack_Boosted", "boosted")):
        parts.append(MetaLearner(kind).fit(meta).predict(wide).select(*p.keys, F.lit(name).alias("model"), "origin", "h", "y", "yhat", "fallback"))
    return stage_union(parts, "stacked")

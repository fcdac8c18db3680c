"""What-if (forward) and target-seeking (inverse) scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import clip, present
from ..shared import key_join, stage
from .arima import arima
from .panel import Panel
from .prep import complete_cases
from .trees import TreeModel, predict_features

REFERENCE_ROWS = 24
STEPS_PER_ROUND = 9
ROUNDS = 3


def future_features(p: Panel, horizon: int) -> DataFrame:
    """Forecast every feature by itself: (keys, h, features).  The features become series of
    one panel, so all of them are fitted in the same jobs."""
    cols = list(p.spec.features)
    long = p.df.select(*p.keys, p.spec.time, *p.spec.tie,
                       F.explode(F.array(*[F.struct(F.lit(c).alias("__feature"), F.col(c).cast("double").alias("__value")) for c in cols])).alias("__i"))
    long = long.select(*p.keys, p.spec.time, *p.spec.tie, "__i.*").where(present(F.col("__value")))
    spec = type(p.spec)(**{**p.spec.__dict__, "keys": (*p.spec.keys, "__feature"), "target": "__value", "features": ()})
    q = Panel(long, spec, (p.n_series * len(cols), p.longest))
    made = arima(q, horizon)
    return made.groupBy(*p.keys, "h").pivot("__feature", cols).agg(F.first("yhat"))


def apply_change(column, op: str, value):
    c = F.col(column)
    return {"add": c + value, "multiply": c * value, "set": F.lit(float(value))}[op]


def changed_frame(future: DataFrame, changes: dict) -> DataFrame:
    """``changes``: feature -> delta, or feature -> (op, value) with op add | multiply | set.
    Unknown features are skipped."""
    for column, change in changes.items():
        if column in future.columns:
            op, value = change if isinstance(change, (tuple, list)) else ("add", change)
            future = future.withColumn(column, apply_change(column, op, value))
    return future


def forward(p: Panel, model: TreeModel, scenarios: dict[str, dict], horizon: int, future: DataFrame | None = None) -> DataFrame:
    """(scenario, keys, h, baseline, changed, delta) for every named set of changes."""
    future = stage(future_features(p, horizon) if future is None else future, "future")
    base = predict_features(model, future, "baseline").select(*p.keys, "h", "baseline")
    parts = [changed_frame(future, ch).withColumn("scenario", F.lit(name)) for name, ch in scenarios.items()]
    made = predict_features(model, reduce(DataFrame.unionByName, parts), "changed").select("scenario", *p.keys, "h", "changed")
    return key_join(made, base, [*p.keys, "h"]).withColumn("delta", F.round(F.col("changed") - F.col("baseline"), 2))


def impact(pairs: DataFrame, keys, mape: float | None = None) -> DataFrame:
    """X1 summary per scenario: mean impact, largest step, warnings."""
    got = pairs.groupBy("scenario", *keys).agg(
        F.round(F.avg("baseline"), 2).alias("baseline_mean"), F.round(F.avg("changed"), 2).alias("changed_mean"),
        F.avg("delta").alias("__mean"), F.round(F.max(F.abs("delta")), 2).alias("max_impact"))
    notes = [F.when(F.abs("__mean") < 0.01, F.lit("negligible impact"))]
    if mape is None:
        notes.append(F.lit("model was not validated before"))
    elif mape > 30:
        notes.append(F.lit(f"model MAPE is {mape:.1f}%: high uncertainty"))
    return got.select("scenario", *keys, "baseline_mean", "changed_mean", F.round("__mean", 2).alias("mean_impact"), "max_impact",
                      F.array_compact(F.array(*notes)).alias("warnings")) \
              .withColumn("status", F.when(F.size("warnings") > 0, "warning").otherwise("ok"))


def reference_point(p: Panel, rows: int = REFERENCE_ROWS) -> DataFrame:
    """Mean of every feature over the last rows, and its historical range, per series."""
    q = complete_cases(p)
    d = q.indexed()
    last = F.col("idx") >= F.col("n") - rows
    cols = list(p.spec.features)
    return d.groupBy(*p.keys).agg(*[e for c in cols for e in (
        F.avg(F.when(last, F.col(c).cast("double"))).alias(c), F.min(F.col(c).cast("double")).alias(f"__lo_{c}"), F.max(F.col(c).cast("double")).alias(f"__hi_{c}"))])


def inverse(p: Panel, model: TreeModel, targets: dict[str, float], features=None, bounds: dict | None = None,
            steps: int = STEPS_PER_ROUND, rounds: int = ROUNDS) -> DataFrame:
    """Feature values that bring the prediction closest to each target.

    All (series, target, candidate) rows are scored in one pass per round; each round zooms
    into the neighbourhood of the best candidate.  ``bounds``: feature -> (low, high), None for
    the historical value; equal bounds fix a feature.  Returns one row per (target, series,
    feature) with current, recommended, change, bounds and the gap."""
    cols = list(p.spec.features)
    if features is None:
        features = [c for c, _ in sorted(model.importances.items(), key=lambda kv: -kv[1]) if c in cols][:3]
    features = list(features)
    start = reference_point(p)
    for c in features:
        lo, hi = (bounds or {}).get(c, (None, None))
        start = start.withColumn(f"__lo_{c}", F.lit(float(lo)) if lo is not None else F.col(f"__lo_{c}")) \
                     .withColumn(f"__hi_{c}", F.lit(float(hi)) if hi is not None else F.col(f"__hi_{c}"))
    spark = p.df.sparkSession
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("goal"), F.lit(float(v)).alias("target_value")) for k, v in targets.items()]))
    start = start.select("*", wanted.alias("__t")).select("*", "__t.*").drop("__t")
    start = predict_features(model, start, "current_predicted")
    state = stage(start.select("*", *[clip(F.col(c), F.col(f"__lo_{c}"), F.col(f"__hi_{c}")).alias(f"__at_{c}") for c in features],
                               *[F.col(f"__lo_{c}").alias(f"__from_{c}") for c in features], *[F.col(f"__hi_{c}").alias(f"__to_{c}") for c in features]), "goal")
    by = [*p.keys, "goal"]
    for _ in range(rounds):
        grid = state
        for c in features:
            low, high = F.col(f"__from_{c}"), F.col(f"__to_{c}")
            inside = [low + i * (high - low) / (steps - 1) for i in range(steps)]
            grid = grid.withColumn(f"__try_{c}", F.explode(F.array(*inside, F.col(f"__at_{c}"))))
        scored = predict_features(model, grid.select(*by, "target_value", *[F.col(f"__try_{c}").alias(c) if c in features else c for c in cols]), "__pred")
        best = scored.groupBy(*by).agg(F.min_by(F.struct("__pred", *features), F.struct(
            F.abs(F.col("__pred") - F.col("target_value")), *features)).alias("__best"))
        moved = key_join(state.drop("__pred"), best, by)
        width = lambda c: (F.col(f"__to_{c}") - F.col(f"__from_{c}")) / (steps - 1)
        keep = [c for c in state.columns if not c.startswith(("__at_", "__from_", "__to_")) and c != "__pred"]
        state = stage(moved.select(*keep, F.col("__best.__pred").alias("__pred"), *[F.col(f"__best.{c}").alias(f"__at_{c}") for c in features],
                                   *[F.greatest(F.col(f"__lo_{c}"), F.col(f"__best.{c}") - width(c)).alias(f"__from_{c}") for c in features],
                                   *[F.least(F.col(f"__hi_{c}"), F.col(f"__best.{c}") + width(c)).alias(f"__to_{c}") for c in features]), "goal")
    gap = F.abs(F.col("__pred") - F.col("target_value"))
    item = lambda c: F.struct(F.lit(c).alias("feature"), F.col(c).alias("current"), F.col(f"__at_{c}").alias("recommended"),
                              F.col(f"__lo_{c}").alias("lower"), F.col(f"__hi_{c}").alias("upper"))
    out = state.select(*by, "target_value", "current_predicted", F.col("__pred").alias("optimized_predicted"), gap.alias("gap"),
                       (gap / F.greatest(F.abs("target_value"), F.lit(0.01)) * 100 > 10).alias("far_from_target"),
                       F.explode(F.array(*[item(c) for c in features])).alias("__i"))
    change = F.col("__i.recommended") - F.col("__i.current")
    return out.select(*by, "target_value", F.round("current_predicted", 2).alias("current_predicted"), F.round("optimized_predicted", 2).alias("optimized_predicted"),
                      F.round("gap", 2).alias("gap"), "far_from_target", "__i.feature", F.round("__i.current", 2).alias("current"),
                      F.round("__i.recommended", 2).alias("recommended"), F.round(change, 2).alias("change"),
                      F.round(change / F.greatest(F.abs("__i.current"), F.lit(0.01)) * 100, 1).alias("change_pct"),
                      F.round("__i.lower", 2).alias("lower"), F.round("__i.upper", 2).alias("upper"))

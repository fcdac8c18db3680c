"""Run a whole request and return its tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import anomaly, blend, explain, prep, profile as prof, registry, whatif
from ..operators.panel import Panel
from ..spec import AnalysisSpec
from .report import collect

DEFAULT_MODELS = ("Naive", "SeasonalNaive", "ARIMA", "ETS")


def prepare(p: Panel, spec: AnalysisSpec) -> Panel:
    """Filters, leading zeros, missing targets: the rows every task works on."""
    filtered = p.fresh(prep.apply_filters(p.df, spec.filters))
    prep.require_rows(filtered.df)
    return prep.drop_missing_target(prep.trim_leading(filtered)).staged("prepared")


def forecast(p: Panel, spec: AnalysisSpec, params: dict | None = None) -> dict:
    names = [m for m in (spec.models or DEFAULT_MODELS) if m not in spec.exclude]
    runs = {m: registry.train_and_forecast(p, m, spec.horizon, params=(params or {}).get(m), n_folds=spec.cv_folds) for m in names}
    forecasts = reduce(DataFrame.unionByName, [r["forecasts"] for r in runs.values()])
    scores = reduce(DataFrame.unionByName, [r["scores"] for r in runs.values()])
    final, weights = blend.combine_forecasts(forecasts, scores, p.keys, "mean_mape")
    out = {"forecasts": forecasts, "scores": scores, "final": final, "weights": weights, "strategy": blend.strategy(scores, registry.families(), p.keys),
           "flags": blend.forecast_flags(final, scores, p.keys, "mean_mape"), "fitted": {m: r["fitted"] for m, r in runs.items() if r["fitted"] is not None}}
    if spec.explain:
        out["series_explanation"] = explain.explain_series(p, spec.period)
        trees = {m: f for m, f in out["fitted"].items() if hasattr(f, "importances")}
        out["explanations"] = {m: explain.explain_trees(p, f, m) for m, f in trees.items()}
    return out


def detect(p: Panel, spec: AnalysisSpec, methods=None) -> dict:
    methods = list(methods or anomaly.DETECTORS)
    params = {"stl": {"period": spec.period}}
    voted = anomaly.vote(p, methods, spec.min_votes, params)
    out = {"anomalies": voted, "summary": anomaly.detection_summary(voted, p.keys, methods, spec.min_votes)}
    if spec.explain:
        out["anomaly_explanation"] = explain.explain_anomalies(p, voted, methods, spec.period)
    return out


def analyze(p: Panel, spec: AnalysisSpec, params: dict | None = None) -> dict:
    """Dispatch by ``spec.task``; ``params`` narrows the grids: model -> list of parameter sets."""
    q = prepare(p, spec)
    out: dict = {}
    if spec.task == "profile" or spec.report:
        out["profile"] = prof.profile(q)
    if spec.task in ("forecast", "both"):
        out.update(forecast(q, spec, params))
    if spec.task in ("anomaly", "both"):
        out.update(detect(q, spec))
    if spec.task in ("whatif", "target"):
        whole = prep.complete_cases(q)
        name = next((m for m in spec.models if registry.MODELS[m].multivariate), "Boosted")
        chosen = ((params or {}).get(name) or [registry.MODELS[name].defaults])[0]
        model = registry.MODELS[name].features(whole, **chosen)
        if spec.task == "whatif":
            pairs = whatif.forward(whole, model, {"changed": spec.changes}, spec.horizon)
            out.update(scenario=pairs, impact=whatif.impact(pairs, q.keys))
        else:
            out["recommendations"] = whatif.inverse(whole, model, {"goal": spec.target_value}, bounds=spec.bounds)
    if spec.report:
        out["report"] = collect(out, q.keys)
    return out

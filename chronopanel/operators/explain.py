"""Explanations of forecasts and anomalies, as tidy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import correlation
from ..shared import key_join
from .autocorrelation import context_windows, lag_correlations, lag_hints, percentile_ranks, statistical_summary
from .decompose import residual_summary, strengths
from .panel import Panel
from .prep import drop_missing_target, split
from .profile import quartile_bounds

FIRST_ANOMALIES = 5
SNAPSHOTS = 10


def first_anomalies(p: Panel, voted: DataFrame, n: int | None = FIRST_ANOMALIES, flag: str = "is_anomaly") -> DataFrame:
    """K4: the first n flagged rows of each series by time (a rank limit, applied before the
    shuffle as well); None: all of them."""
    w = Window.partitionBy(*p.keys).orderBy(*[F.col(c).asc_nulls_last() for c in (p.spec.time, *p.spec.tie)])
    ranked = voted.where(F.col(flag)).withColumn("rank_no", F.row_number().over(w))
    if n is not None:
        ranked = ranked.where(F.col("rank_no") <= n)
    return ranked.withColumn("rank_no", F.col("rank_no").cast("long"))


def zscore_context(p: Panel, voted: DataFrame, n: int | None = FIRST_ANOMALIES) -> DataFrame:
    """Signed z (std with ddof 1, plus 1e-8) and deviation in % of the mean."""
    stats = p.aggregate(F.avg(p.y).alias("mean"), (F.stddev_samp(p.y) + 1e-8).alias("std"))
    out = p.attach(first_anomalies(p, voted, n), stats)
    v = p.y.cast("double")
    return out.select(*p.keys, "rank_no", p.spec.time, v.alias("value"), "mean", "std",
                      ((v - F.col("mean")) / F.col("std")).alias("zscore"),
                      F.when(F.col("mean") != 0, (v - F.col("mean")) / F.col("mean") * 100).otherwise(0.0).alias("deviation_pct"))


def iqr_context(p: Panel) -> DataFrame:
    """N2."""
    b = quartile_bounds(p)
    return b.withColumn("expected_range", F.format_string("%.2f - %.2f", "lower_bound", "upper_bound"))


def method_agreement(voted: DataFrame, keys, methods) -> DataFrame:
    """Flags per method, and their sum over the number of methods."""
    c = voted.groupBy(*keys).agg(*[F.sum(F.col(f"flag_{m}").cast("long")).alias(f"n_{m}") for m in methods])
    total = sum((F.col(f"n_{m}") for m in methods), F.lit(0))
    return c.withColumn("average_agreement", total / float(len(methods))).withColumn("total_methods", F.lit(len(methods)).cast("long"))


def anomaly_percentiles(p: Panel, voted: DataFrame, n: int = FIRST_ANOMALIES) -> DataFrame:
    """N5."""
    picked = first_anomalies(p, voted, n).select(*p.keys, "rank_no", p.y.cast("double").alias("value"))
    return percentile_ranks(p, picked, n)


def snapshots(p: Panel, voted: DataFrame, n: int | None = SNAPSHOTS, reach: int = 2) -> DataFrame:
    """Values around the first n anomalies."""
    have = [c for c in ("idx", "n") if c in voted.columns]
    d = context_windows(p, reach, voted.drop(*have))
    cols = [f"{c}_window" for c in (p.spec.target, *p.spec.features)]
    return first_anomalies(p, d, n).select(*p.keys, "rank_no", p.spec.time, "idx", F.round(p.y.cast("double"), 3).alias("value"), *cols)


def explain_anomalies(p: Panel, voted: DataFrame, methods, period: int = 24, method: str = "stl") -> dict[str, DataFrame]:
    """All anomaly explanations."""
    q = drop_missing_target(p)
    return {"zscore": zscore_context(q, voted), "iqr": iqr_context(q), "stl": residual_summary(q, period, method),
            "method_agreement": method_agreement(voted, p.keys, methods), "percentiles": anomaly_percentiles(q, voted),
            "snapshots": snapshots(q, voted)}


# ---- forecasts -----------------------------------------------------------------------------

def feature_correlations(p: Panel, columns=None) -> DataFrame:
    """Pearson correlation of each feature with the target (NaN -> 0): one aggregation."""
    cols = list(columns or p.spec.features)
    c = p.aggregate(*[correlation(F.col(f).cast("double"), p.y.cast("double")).alias(f"__c{i}") for i, f in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"__c{i}").alias("correlation")) for i, f in enumerate(cols)])
    return c.select(*p.keys, F.explode(rows).alias("__i")).select(*p.keys, "__i.*")


def top_features(importance: DataFrame, keys=(), n: int = 3) -> DataFrame:
    """K3: the n most important features."""
    w = Window.partitionBy(*keys).orderBy(F.col("importance_pct").desc(), "feature")
    return importance.withColumn("rank_no", F.row_number().over(w).cast("long")).where(F.col("rank_no") <= n)


def reconcile(importance: DataFrame, shap: DataFrame, correlation: DataFrame, keys=()) -> DataFrame:
    """Importance, Shapley share and correlation side by side with a reading."""
    on = [*keys, "feature"]
    out = shap.join(correlation, on, "full")
    out = out.join(importance.select(*[k for k in keys if k in importance.columns], "feature", "importance_pct"),
                   [*[k for k in keys if k in importance.columns], "feature"], "full")
    z = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("importance_pct", "shap_pct", "correlation")}
    hint = (F.when((z["shap_pct"] > 10) & (F.abs(z["correlation"]) > 0.2), "direct driver")
            .when((F.abs(z["correlation"]) < 0.1) & (z["importance_pct"] > 5), "non-linear effect"))
    return out.select(*on, *[c.alias(n) for n, c in z.items()], hint.alias("hint"))


def describe_models(models: DataFrame, model: str = "model", last_value: str = "last_value", period: str = "seasonal_period") -> DataFrame:
    """One line per model about how it forecasts."""
    m = F.col(model)
    days = F.floor(F.col(period) / 24).cast("long")
    text = (F.when(m == "Naive", F.format_string("Repeats the latest value, %.2f.", F.coalesce(F.col(last_value), F.lit(0.0))))
            .when(m == "SeasonalNaive", F.format_string("Repeats the values of %d day(s) before.", F.coalesce(days, F.lit(1))))
            .when(m == "ARIMA", "Linear in past values and past errors (ARIMA).")
            .when(m == "Boosted", "Boosted trees over lagged values.")
            .when(m == "RandomForest", "Average of many trees over lagged values.")
            .otherwise(F.format_string("Forecast of the model %s.", m)))
    return models.withColumn("explanation", text)


def train_part(p: Panel, fraction: float = 0.8) -> Panel:
    rows = split(p, fraction).where("is_train").drop("idx", "n", "is_train")
    return p.derive(rows)


def explain_series(p: Panel, period: int = 24, method: str = "stl") -> dict[str, DataFrame]:
    """The model-independent part of a forecast explanation."""
    train = train_part(p)
    lags = lag_correlations(train)
    out = {"summary": statistical_summary(p, period), "decomposition": strengths(train, period, method),
           "lags": lags, "lag_hints": lag_hints(lags)}
    if p.spec.features:
        out["correlations"] = feature_correlations(p)
    return out


def explain_trees(p: Panel, model, name: str) -> dict[str, DataFrame]:
    """E4-E6 for one tree model."""
    from .trees import importance_table, shap_summary
    importance = importance_table(p.df.sparkSession, model, name)
    shap = shap_summary(p, model)
    if p.spec.features and model.mode != "lags":
        corr = feature_correlations(p)
    else:
        from .trees import lag_table
        lt = lag_table(p, model.n_lags, model.exog, model.scale)
        corr = feature_correlations(p.derive(lt, target="__label", features=tuple(model.columns)))
    return {"importance": importance, "shap": shap, "reconciliation": reconcile(importance, shap, corr, p.keys)}

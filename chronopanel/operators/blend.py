"""Blending of model forecasts.

``scores`` tables hold (keys, model, score); forecasts hold (keys, model, h, yhat)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import is_finite
from ..shared import key_join

EPSILON = 1e-6
FLOOR = 0.01
TOP_MODELS = 5


def _share(scores: DataFrame, keys, raw) -> DataFrame:
    w = Window.partitionBy(*keys)  # one row per model: a group is as small as the model list
    return scores.withColumn("__w", raw).withColumn("weight", F.col("__w") / F.sum("__w").over(w)).drop("__w")


def inverse_error(scores: DataFrame, keys, score: str = "score") -> DataFrame:
    """B1: 1/(score + 1e-6); a score that is not finite counts as 1e10."""
    s = F.when(is_finite(F.col(score)), F.col(score)).otherwise(1e10)
    return _share(scores, keys, 1.0 / (s + EPSILON))


def softmax(scores: DataFrame, keys, score: str = "score") -> DataFrame:
    """B2: softmax of the negative score."""
    low = F.min(score).over(Window.partitionBy(*keys))
    return _share(scores, keys, F.exp(low - F.col(score)))


def uniform(scores: DataFrame, keys) -> DataFrame:
    """B3."""
    return _share(scores, keys, F.lit(1.0))


def top_models(scores: DataFrame, keys, score: str = "score", n: int | None = TOP_MODELS) -> DataFrame:
    """K1: the n best models (None: all, ranked)."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).asc_nulls_last(), "model")
    ranked = scores.withColumn("rank_no", F.row_number().over(w).cast("long"))
    return ranked if n is None else ranked.where(F.col("rank_no") <= n)


def floored_inverse(scores: DataFrame, keys, score: str = "score", n: int | None = TOP_MODELS) -> DataFrame:
    """1/max(score, 0.01) over the best n models."""
    top = top_models(scores, keys, score, n) if n else scores
    return _share(top, keys, 1.0 / F.greatest(F.coalesce(F.col(score), F.lit(1e10)), F.lit(FLOOR)))


def combine(forecasts: DataFrame, weights: DataFrame, keys) -> DataFrame:
    """Weighted mean per step; a model without weight gets 1/m, weights are renormalized."""
    w = weights.select(*keys, "model", "weight")
    f = key_join(forecasts, w, [*keys, "model"], "left")
    models = forecasts.groupBy(*keys).agg(F.count_distinct("model").alias("__m"))
    f = key_join(f, models, keys)
    weight = F.coalesce("weight", 1.0 / F.col("__m"))
    return f.groupBy(*keys, "h").agg((F.sum(weight * F.col("yhat")) / F.sum(weight)).alias("yhat"))


def median(forecasts: DataFrame, keys) -> DataFrame:
    """Median across models (a group holds one value per model)."""
    return forecasts.groupBy(*keys, "h").agg(F.median("yhat").alias("yhat"))


def best_model(forecasts: DataFrame, scores: DataFrame, keys, score: str = "score") -> DataFrame:
    """The forecast of the best model."""
    best = top_models(scores, keys, score, 1).select(*keys, "model")
    return key_join(forecasts, best, [*keys, "model"])


def trimmed_mean(forecasts: DataFrame, scores: DataFrame, keys, score: str = "score", drop: int = 3, least: int = 3) -> DataFrame:
    """Mean without the ``drop`` worst models, at least ``least`` kept."""
    w = Window.partitionBy(*keys)
    ranked = top_models(scores, keys, score, None).withColumn("__m", F.count(F.lit(1)).over(w))
    keep = ranked.where(F.col("rank_no") <= F.greatest(F.lit(least), F.col("__m") - drop)).select(*keys, "model")
    return key_join(forecasts, keep, [*keys, "model"]).groupBy(*keys, "h").agg(F.avg("yhat").alias("yhat"))


def strategy(summary: DataFrame, families: dict[str, str], keys, n: int | None = TOP_MODELS) -> DataFrame:
    """One row per series about the chosen models: best model, spread, family diversity,
    mean fold std and whether it is high (> 5), and the inverse-error weights as a list."""
    known = [(k, v) for k, v in families.items()]
    fam = F.create_map(*[F.lit(x) for kv in known for x in kv])
    top = top_models(summary, keys, "mean_mape", n)
    w = inverse_error(top, keys, "mean_mape").withColumn("family", F.coalesce(F.get(F.array(fam), F.lit(0))[F.col("model")], F.lit("?")))
    got = w.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_models"), F.min_by("model", "rank_no").alias("best_model"), F.min("mean_mape").alias("best_mape"),
        (F.max("mean_mape") - F.min("mean_mape")).alias("error_spread"), F.count_distinct("family").alias("n_families"),
        F.avg("std_mape").alias("avg_std"),
        F.array_sort(F.collect_list(F.struct("rank_no", "model", "weight", F.round("mean_mape", 2).alias("mape"), F.round("std_mape", 2).alias("std")))).alias("models"))
    return got.withColumn("strategy", F.when(F.col("n_models") == 1, "best_model").otherwise("weighted")) \
              .withColumn("high_variance", F.col("avg_std") > 5)


def forecast_flags(forecasts: DataFrame, scores: DataFrame, keys, score: str = "score", limit: float = 50.0) -> DataFrame:
    """Per forecast: best score above ``limit``, nearly constant, not finite."""
    f = forecasts.groupBy(*keys).agg(
        (F.coalesce(F.stddev_pop("yhat"), F.lit(0.0)) < 1e-6).alias("__flat"), F.count(F.lit(1)).alias("n_predictions"),
        F.bool_or(~is_finite(F.col("yhat"))).alias("not_finite"))
    s = scores.groupBy(*keys).agg(F.min(score).alias("best_score"))
    out = key_join(f, s, keys)
    high = F.coalesce(F.col("best_score") > limit, F.lit(True))
    flat = F.col("__flat") & (F.col("n_predictions") > 1)
    return out.select(*keys, "n_predictions", "best_score", high.alias("high_error"), flat.alias("constant"), "not_finite",
                      F.when(high | flat | F.col("not_finite"), "warning").otherwise("ok").alias("status"))


def combine_forecasts(forecasts: DataFrame, scores: DataFrame, keys, score: str = "score", n: int = TOP_MODELS):
    """(final forecast, weights): the best models blended by floored inverse error; a
    single model is its own forecast."""
    weights = floored_inverse(scores, keys, score, n)
    chosen = key_join(forecasts, weights.select(*keys, "model"), [*keys, "model"])
    return combine(chosen, weights, keys), weights.select(*keys, "model", "weight")

"""Registered queries: forecasters, validation, blending, forecast explanation, scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import arima, blend, explain, mlp, naive, registry, smoothing, stacking, trees, validation, whatif
from ..operators.panel import Panel
from ..shared import stage_union
from .data import DIX, HOURLY, IX, daily, fitted, hourly, kept, query, r, rounded, shipped

H = 24
FRAME = f"range(1, {H + 1}) h(h)"

#: the naive family: cheap models whose folds, scores and blends SQL can restate
SEASONS = {"Naive": 1, "SN07": 7, "SN12": 12, "SN24": 24}
_MODELS = "(VALUES " + ", ".join(f"('{m}', {s})" for m, s in SEASONS.items()) + ") m(model, sp)"


def _model(name):
    return (naive.naive, {}) if name == "Naive" else (naive.seasonal_naive, {"seasonal_period": SEASONS[name]})


def forecasts(spark, sf) -> DataFrame:
    p = hourly(spark, sf)
    def build():
        parts = []
        for m in SEASONS:
            fn, params = _model(m)
            parts.append(fn(p, H, **params).select("event_type", F.lit(m).alias("model"), F.col("h").cast("long").alias("h"), "yhat"))
        return stage_union(parts, "forecasts")
    return kept(spark, sf, "forecasts", build)


def fold_scores(spark, sf) -> DataFrame:
    p = hourly(spark, sf)
    def build():
        parts = []
        for m, sp in SEASONS.items():
            fn, params = _model(m)
            parts.append(validation.cross_validate(p, fn, H, params, context=sp).withColumn("model", F.lit(m)))
        return stage_union(parts, "fold_scores")
    return kept(spark, sf, "fold_scores", build)


def scores(spark, sf) -> DataFrame:
    return validation.summarize_folds(fold_scores(spark, sf), ["event_type", "model"])


FOLDS = f"""{IX}, sizes AS (SELECT event_type, min(n) AS n FROM ix GROUP BY 1),
  folds AS (SELECT * FROM (SELECT event_type, f::BIGINT AS fold, (50 + f * greatest(1, floor((n - 50 - {H}) / 3)))::BIGINT AS origin, n FROM sizes, range(3) f(f)) WHERE origin + {H} <= n)"""
FORECASTS = f"fc AS (SELECT x.event_type, m.model, h::BIGINT AS h, x.y AS yhat FROM sizes s, {_MODELS}, {FRAME} JOIN ix x ON x.idx = s.n - m.sp + (h - 1) % m.sp AND x.event_type = s.event_type)".replace(
    f"FROM sizes s, {_MODELS}, {FRAME} JOIN ix x ON x.idx = s.n - m.sp + (h - 1) % m.sp AND x.event_type = s.event_type",
    f"FROM sizes s CROSS JOIN {_MODELS} CROSS JOIN {FRAME} JOIN ix x ON x.event_type = s.event_type AND x.idx = s.n - m.sp + (h - 1) % m.sp")
SCORES = f"""{FOLDS}, pred AS (SELECT f.event_type, m.model, f.fold, f.origin, h, x.y AS yhat, a.y AS y FROM folds f CROSS JOIN {_MODELS} CROSS JOIN {FRAME}
    JOIN ix x ON x.event_type = f.event_type AND x.idx = f.origin - m.sp + (h - 1) % m.sp JOIN ix a ON a.event_type = f.event_type AND a.idx = f.origin + h - 1),
  fold_scores AS (SELECT event_type, model, fold, avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) * 100 AS mape, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
    coalesce(avg(CASE WHEN abs(y) + abs(yhat) > 0 THEN 2 * abs(y - yhat) / (abs(y) + abs(yhat)) END) * 100, 0) AS smape FROM pred GROUP BY 1, 2, 3),
  scores AS (SELECT event_type, model, avg(mape) AS mean_mape, stddev_pop(mape) AS std_mape, count(mape) AS n_folds FROM fold_scores GROUP BY 1, 2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY mean_mape, model) AS rank_no FROM scores)"""


@query("m1_naive", f"WITH {IX} SELECT event_type, h::BIGINT AS h, {r('yhat')} FROM (SELECT event_type, y AS yhat FROM ix WHERE idx = n - 1) CROSS JOIN {FRAME}")
def _(spark, sf):
    return rounded(naive.naive(hourly(spark, sf), H).drop("fallback"))


@query("m2_seasonal_naive", f"WITH {IX} SELECT event_type, h::BIGINT AS h, round(y, 6) + 0.0 AS yhat FROM {FRAME} JOIN ix ON idx = n - 12 + (h - 1) % 12")
def _(spark, sf):
    return rounded(naive.seasonal_naive(hourly(spark, sf), H).drop("fallback"))


@query("m3_arima")
def _(spark, sf):
    return rounded(arima.arima(hourly(spark, sf), H))


@query("m3_arima_first_order", f"""WITH {IX}, x AS (SELECT *, lag(y) OVER (PARTITION BY event_type ORDER BY ts) AS z FROM ix),
  g AS (SELECT event_type, count(*) AS m, regr_slope(y, z) AS b, regr_intercept(y, z) AS a, avg(y) AS mu, var_pop(y) * count(*) AS rss0 FROM x WHERE idx >= 13 GROUP BY 1),
  e AS (SELECT event_type, m, a, b, mu, rss0, sum((y - a - b * z) ** 2) AS rss1 FROM x JOIN g USING (event_type) WHERE idx >= 13 GROUP BY ALL),
  c AS (SELECT *, abs(b) < 0.999 AND m * ln(rss1 / m) + 6 < m * ln(rss0 / m) + 4 AS ar FROM e)
  SELECT c.event_type, h::BIGINT AS h, round(CASE WHEN ar THEN a * (1 - b ** h) / (1 - b) + b ** h * ix.y ELSE mu END, 6) + 0.0 AS yhat
  FROM c JOIN ix ON ix.event_type = c.event_type AND ix.idx = ix.n - 1 CROSS JOIN {FRAME}""")
def _(spark, sf):
    return rounded(arima.arima(hourly(spark, sf), H, 1, 0, 0).drop("fallback"))


@query("m3_arima_orders")
def _(spark, sf):
    return rounded(arima.fit_arima(shipped(spark, sf)).select("l_returnflag", "p", "d", "q", "aic"))


@query("m4_ets")
def _(spark, sf):
    return rounded(smoothing.ets(hourly(spark, sf), H, "add", "add", 24))


@query("m4_ets_multiplicative")
def _(spark, sf):
    return rounded(smoothing.ets(daily(spark, sf), H, "none", "mul", 7))


@query("m5_m12_forest_lags")
def _(spark, sf):
    p = hourly(spark, sf)
    return rounded(trees.forecast_lag_trees(p, trees.fit_lag_trees(p, "forest", 12), H))


@query("m6_boosted_lags")
def _(spark, sf):
    p = hourly(spark, sf)
    return rounded(trees.forecast_lag_trees(p, trees.fit_lag_trees(p, "boosted", 12), H))


@query("m7_forest_features")
def _(spark, sf):
    p = shipped(spark, sf)
    m = fitted(spark, sf, "forest", lambda: trees.fit_feature_trees(p, "forest"))
    return rounded(trees.predict_features(m, p.df).select("l_returnflag", "ts", "yhat"))


@query("m8_boosted_features")
def _(spark, sf):
    p = shipped(spark, sf)
    m = trees.fit_feature_trees(p, "boosted")
    return rounded(trees.predict_features(m, p.df).select("l_returnflag", "ts", "yhat"))


def _combined(spark, sf, kind, **params):
    p = shipped(spark, sf)
    m = trees.fit_lag_trees(p, kind, exog=p.spec.features, **params)
    return rounded(trees.forecast_lag_trees(p, m, H, whatif.future_features(p, H)))


@query("m9_m13_forest_combined")
def _(spark, sf):
    return _combined(spark, sf, "forest")


@query("m10_boosted_combined")
def _(spark, sf):
    return _combined(spark, sf, "boosted")


@query("m11_network")
def _(spark, sf):
    p = hourly(spark, sf)
    return rounded(mlp.forecast_mlp(p, mlp.fit_mlp(p), H))


@query("m14_train_once_score_origins")
def _(spark, sf):
    p = hourly(spark, sf)
    m = trees.fit_lag_trees(explain.train_part(p), "forest", 12)
    at = validation.origin_panel(p, validation.evaluation_origins(p, H), 12)
    pairs = validation.with_actuals(p, trees.forecast_lag_trees(at, m, H))
    return rounded(validation.score(pairs, ["event_type"]))


@query("m16_forecast_flags", f"""WITH {SCORES}, {FORECASTS}, f AS (SELECT event_type, model, stddev_pop(yhat) < 1e-6 AS constant, count(*) AS n_predictions FROM fc GROUP BY 1, 2)
  SELECT event_type, model, n_predictions, round(mean_mape, 6) + 0.0 AS best_score, mean_mape > 50 AS high_error, constant, false AS not_finite,
  CASE WHEN mean_mape > 50 OR constant THEN 'warning' ELSE 'ok' END AS status FROM f JOIN scores USING (event_type, model)""")
def _(spark, sf):
    return rounded(blend.forecast_flags(forecasts(spark, sf), scores(spark, sf), ["event_type", "model"], "mean_mape"))


@query("m17_train_and_forecast", f"""WITH {SCORES}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY mean_mape, model) AS k FROM scores WHERE model <> 'Naive') WHERE k = 1)
  SELECT b.event_type, h::BIGINT AS h, round(x.y, 6) + 0.0 AS yhat, round(b.mean_mape, 6) + 0.0 AS mean_mape, round(b.std_mape, 6) + 0.0 AS std_mape
  FROM best b JOIN {_MODELS} ON m.model = b.model CROSS JOIN {FRAME} JOIN ix x ON x.event_type = b.event_type AND x.idx = x.n - m.sp + (h - 1) % m.sp""")
def _(spark, sf):
    p = hourly(spark, sf)
    got = registry.train_and_forecast(p, "SeasonalNaive", H, params=[{"seasonal_period": s} for s in (7, 12, 24)])
    return rounded(p.attach(got["forecasts"].select("event_type", "h", "yhat"), got["scores"].select("event_type", "mean_mape", "std_mape")))


@query("v1_folds", f"WITH {FOLDS} SELECT event_type, fold, origin, {H}::BIGINT AS fold_h FROM folds")
def _(spark, sf):
    return validation.folds(hourly(spark, sf), H)


@query("v1_v2_folds_short_series", f"""WITH {HOURLY}, d AS (SELECT event_type, (count(*) * (CASE WHEN event_type < 'p' THEN 1.0 ELSE 0.1 END))::INT AS n FROM hourly GROUP BY 1)
  SELECT 1 AS x FROM d WHERE false""".replace("SELECT 1 AS x FROM d WHERE false", """SELECT event_type, fold, origin, least(40, n - origin)::BIGINT AS fold_h FROM (
    SELECT event_type, f::BIGINT AS fold, n, (CASE WHEN n >= 120 THEN 80 + f * greatest(1, floor((n - 120) / 3)) WHEN f = 0 THEN greatest(1, n - 40) END)::BIGINT AS origin FROM (
      SELECT event_type, count(*) AS n FROM hourly WHERE event_type < 'p' OR ts < TIMESTAMP '2024-01-04' GROUP BY 1), range(3) f(f))
    WHERE origin IS NOT NULL AND (n < 120 OR origin + 40 <= n)"""))
def _(spark, sf):
    p = hourly(spark, sf)
    short = p.fresh(p.df.where("event_type < 'p' OR ts < timestamp_ntz'2024-01-04 00:00:00'"))
    return validation.folds(short, 40)


@query("v3_fold_metrics", f"WITH {SCORES} SELECT event_type, model, fold, {r('mape', 'mae', 'rmse', 'smape')} FROM fold_scores")
def _(spark, sf):
    return rounded(fold_scores(spark, sf))


@query("j3_predictions_and_actuals", f"WITH {SCORES} SELECT event_type, origin, h, {r('y', 'yhat')} FROM pred WHERE model = 'SN12'")
def _(spark, sf):
    p = hourly(spark, sf)
    at = validation.origin_panel(p, validation.folds(p, H), 12, 3)
    return rounded(validation.with_actuals(p, naive.seasonal_naive(at, H)).select("event_type", "origin", "h", "y", "yhat"))


@query("v4_mase", f"""WITH {SCORES}, sc AS (SELECT a.event_type, avg(abs(a.y - b.y)) AS s FROM ix a JOIN ix b ON a.event_type = b.event_type AND b.idx = a.idx - 24 WHERE a.idx < floor(a.n * 0.8) GROUP BY 1)
  SELECT event_type, model, fold, {r('mae')}, round(mae / CASE WHEN s < 1e-9 THEN 1 ELSE s END, 6) + 0.0 AS mase FROM fold_scores JOIN sc USING (event_type)""")
def _(spark, sf):
    p = hourly(spark, sf)
    return rounded(validation.add_mase(p, fold_scores(spark, sf).select("event_type", "model", "fold", "mae"), 24))


@query("v5_grid_search", f"""WITH {SCORES} SELECT event_type, model AS params_id, {r('mean_mape', 'std_mape')}, n_folds FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY mean_mape, model) AS k FROM scores) WHERE k = 1""")
def _(spark, sf):
    s = scores(spark, sf).withColumnRenamed("model", "params_id")
    return rounded(validation.pick_best(s, ["event_type"]))


@query("v5_v6_forest_search")
def _(spark, sf):
    p = hourly(spark, sf)
    got = registry.train_and_forecast(p, "RandomForest", H)
    return rounded(p.attach(got["forecasts"], got["scores"].drop("model")))


@query("v5_v6_boosted_multivariate")
def _(spark, sf):
    p = shipped(spark, sf)
    got = registry.train_and_forecast(p, "Boosted", H, params=[{"n_estimators": 3, "num_leaves": 8}], n_folds=2)
    return rounded(p.attach(got["forecasts"], got["scores"].drop("model")))


ORIGINS = f"""{IX}, o AS (SELECT event_type, n, floor(n * 0.8) AS tr, floor((n - floor(n * 0.8) - 6) / 6) + 1 AS total FROM ix GROUP BY 1, 2),
  orig AS (SELECT event_type, w::BIGINT AS "window", (tr + CASE WHEN total > 10 THEN floor(w * (total - 1) / 9) ELSE w END * 6)::BIGINT AS origin FROM o, range(10) w(w) WHERE total >= 1 AND w < total)"""


@query("k6_evaluation_origins", f"WITH {ORIGINS} SELECT * FROM orig")
def _(spark, sf):
    return validation.evaluation_origins(hourly(spark, sf), 6, 0.8, 10)


ROLLING = f"""{ORIGINS}, pred AS (SELECT f.event_type, m.model, f.origin, h, x.y AS yhat, a.y AS y FROM orig f CROSS JOIN {_MODELS} CROSS JOIN range(1, 7) h(h)
    JOIN ix x ON x.event_type = f.event_type AND x.idx = f.origin - m.sp + (h - 1) % m.sp JOIN ix a ON a.event_type = f.event_type AND a.idx = f.origin + h - 1 WHERE m.model IN ('Naive', 'SN12', 'SN24')),
  res AS (SELECT event_type AS dataset, 6::BIGINT AS horizon, model, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
    avg(CASE WHEN abs(y) + abs(yhat) > 0 THEN 2 * abs(y - yhat) / (abs(y) + abs(yhat)) END) * 100 AS smape FROM pred GROUP BY 1, 2, 3)"""


def _rolling(spark, sf):
    p = hourly(spark, sf)
    return kept(spark, sf, "rolling", lambda: validation.rolling_origin(
        p, {m: (*_model(m), SEASONS[m]) for m in ("Naive", "SN12", "SN24")}, 6, 0.8, 10))


def _results(spark, sf):
    s = validation.score(_rolling(spark, sf), ["event_type", "model"], ("mae", "rmse", "smape"))
    return s.select(F.col("event_type").alias("dataset"), F.lit(6).cast("long").alias("horizon"), "model", "mae", "rmse", "smape")


@query("v7_u2_rolling_origin", f"WITH {ROLLING} SELECT event_type, model, origin, h::BIGINT AS h, {r('y', 'yhat')} FROM pred")
def _(spark, sf):
    return rounded(_rolling(spark, sf).select("event_type", "model", "origin", "h", "y", "yhat"))


@query("v7_rolling_origin_refit")
def _(spark, sf):
    p = hourly(spark, sf)
    pairs = validation.rolling_origin(p, {"ETS": (smoothing.ets, {"seasonal_periods": 24}, None), "ARIMA": (arima.arima, {}, None)}, 6)
    return rounded(validation.score(pairs, ["event_type", "model"]))


@query("v7_arima_at_origins", f"""WITH {ORIGINS}, x AS (SELECT *, lag(y) OVER (PARTITION BY event_type ORDER BY ts) AS z FROM ix),
  t AS (SELECT x.event_type, origin, idx, y, z FROM x JOIN orig ON x.event_type = orig.event_type AND x.idx >= 13 AND x.idx < origin),
  g AS (SELECT event_type, origin, count(*) AS m, regr_slope(y, z) AS b, regr_intercept(y, z) AS a, avg(y) AS mu, var_pop(y) * count(*) AS rss0 FROM t GROUP BY 1, 2),
  e AS (SELECT event_type, origin, m, a, b, mu, rss0, sum((y - a - b * z) ** 2) AS rss1 FROM t JOIN g USING (event_type, origin) GROUP BY ALL),
  c AS (SELECT *, abs(b) < 0.999 AND m * ln(rss1 / m) + 6 < m * ln(rss0 / m) + 4 AS ar FROM e)
  SELECT c.event_type, origin, h::BIGINT AS h, round(CASE WHEN ar THEN a * (1 - b ** h) / (1 - b) + b ** h * ix.y ELSE mu END, 6) + 0.0 AS yhat
  FROM c JOIN ix ON ix.event_type = c.event_type AND ix.idx = c.origin - 1 CROSS JOIN range(1, 7) h(h)""")
def _(spark, sf):
    p = hourly(spark, sf)
    return rounded(arima.arima_at(p, validation.evaluation_origins(p, 6, 0.8, 10), 6, 10, 1, 0, 0).drop("fallback"))


@query("v8_leaderboard", f"WITH {ROLLING} SELECT horizon, model, round(avg(mae), 6) + 0.0 AS mae, round(avg(rmse), 6) + 0.0 AS rmse, round(avg(smape), 6) + 0.0 AS smape FROM res GROUP BY 1, 2")
def _(spark, sf):
    return rounded(validation.leaderboard(_results(spark, sf), metrics=("mae", "rmse", "smape")))


@query("v8_overall_ranking", f"WITH {ROLLING} SELECT model, round(avg(mae), 6) + 0.0 AS mae FROM res GROUP BY 1")
def _(spark, sf):
    return rounded(validation.leaderboard(_results(spark, sf), ("model",), ("mae",)))


@query("k7_best_per_dataset", f"WITH {ROLLING} SELECT dataset, horizon, model, {r('mae', 'rmse', 'smape')} FROM (SELECT *, row_number() OVER (PARTITION BY dataset, horizon ORDER BY mae, model) AS k FROM res) WHERE k = 1")
def _(spark, sf):
    return rounded(validation.best_per_group(_results(spark, sf)))


def _scored(spark, sf):
    return scores(spark, sf).select("event_type", "model", F.col("mean_mape").alias("score"))


@query("k1_top_models", f"WITH {SCORES} SELECT event_type, model, round(mean_mape, 6) + 0.0 AS score, rank_no FROM ranked WHERE rank_no <= 3")
def _(spark, sf):
    return rounded(blend.top_models(_scored(spark, sf), ["event_type"], n=3))


def _weights(expr, where="rank_no <= 4"):
    return f"WITH {SCORES}, w AS (SELECT *, {expr} AS w FROM ranked WHERE {where}) SELECT event_type, model, round(w / sum(w) OVER (PARTITION BY event_type), 6) + 0.0 AS weight FROM w"


@query("b1_inverse_error", _weights("1 / (mean_mape + 1e-6)"))
def _(spark, sf):
    return rounded(blend.inverse_error(_scored(spark, sf), ["event_type"]).drop("score"))


@query("b2_softmax", _weights("exp(min(mean_mape) OVER (PARTITION BY event_type) - mean_mape)"))
def _(spark, sf):
    return rounded(blend.softmax(_scored(spark, sf), ["event_type"]).drop("score"))


@query("b3_uniform", _weights("1.0"))
def _(spark, sf):
    return rounded(blend.uniform(_scored(spark, sf), ["event_type"]).drop("score"))


@query("b4_b9_floored_inverse", _weights("1 / greatest(mean_mape, 0.01)", "rank_no <= 3"))
def _(spark, sf):
    return rounded(blend.floored_inverse(_scored(spark, sf), ["event_type"], n=3).select("event_type", "model", "weight"))


@query("b5_combine", f"""WITH {SCORES}, {FORECASTS}, w AS (SELECT event_type, model, 1 / greatest(mean_mape, 0.01) AS w FROM ranked WHERE rank_no <= 3), ws AS (SELECT event_type, model, w / sum(w) OVER (PARTITION BY event_type) AS w FROM w)
  SELECT event_type, h, round(sum(coalesce(w, 0.25) * yhat) / sum(coalesce(w, 0.25)), 6) + 0.0 AS yhat FROM fc LEFT JOIN ws USING (event_type, model) GROUP BY 1, 2""")
def _(spark, sf):
    w = blend.floored_inverse(_scored(spark, sf), ["event_type"], n=3)
    return rounded(blend.combine(forecasts(spark, sf), w, ["event_type"]))


@query("b6_median", f"WITH {SCORES}, {FORECASTS} SELECT event_type, h, round(median(yhat), 6) + 0.0 AS yhat FROM fc GROUP BY 1, 2")
def _(spark, sf):
    return rounded(blend.median(forecasts(spark, sf), ["event_type"]))


@query("j6_aligned_stack", f"WITH {SCORES}, {FORECASTS} SELECT event_type, h, count(*) AS n_models, round(min(yhat), 6) + 0.0 AS low, round(max(yhat), 6) + 0.0 AS high FROM fc GROUP BY 1, 2")
def _(spark, sf):
    return rounded(forecasts(spark, sf).groupBy("event_type", "h").agg(F.count(F.lit(1)).alias("n_models"), F.min("yhat").alias("low"), F.max("yhat").alias("high")))


@query("b7_best_model", f"WITH {SCORES}, {FORECASTS} SELECT event_type, model, h, {r('yhat')} FROM fc JOIN ranked USING (event_type, model) WHERE rank_no = 1")
def _(spark, sf):
    return rounded(blend.best_model(forecasts(spark, sf), _scored(spark, sf), ["event_type"]))


@query("b8_trimmed_mean", f"WITH {SCORES}, {FORECASTS} SELECT event_type, h, round(avg(yhat), 6) + 0.0 AS yhat FROM fc JOIN ranked USING (event_type, model) WHERE rank_no <= 3 GROUP BY 1, 2")
def _(spark, sf):
    return rounded(blend.trimmed_mean(forecasts(spark, sf), _scored(spark, sf), ["event_type"]))


@query("b10_strategy", f"""WITH {SCORES} SELECT event_type, count(*) AS n_models, min_by(model, rank_no) AS best_model, round(min(mean_mape), 6) + 0.0 AS best_mape, round(max(mean_mape) - min(mean_mape), 6) + 0.0 AS error_spread,
  1::BIGINT AS n_families, round(avg(std_mape), 6) + 0.0 AS avg_std, 'weighted' AS strategy, avg(std_mape) > 5 AS high_variance FROM ranked GROUP BY 1""")
def _(spark, sf):
    return rounded(blend.strategy(scores(spark, sf), {m: "statistical" for m in SEASONS}, ["event_type"]).drop("models"))


@query("b11_b12_combined_forecast", f"""WITH {SCORES}, {FORECASTS}, w AS (SELECT event_type, model, 1 / greatest(mean_mape, 0.01) AS w FROM ranked WHERE rank_no <= 2),
  c AS (SELECT event_type, h, sum(w * yhat) / sum(w) AS yhat FROM fc JOIN w USING (event_type, model) GROUP BY 1, 2),
  s AS (SELECT event_type, min(mean_mape) AS best_score FROM scores GROUP BY 1)
  SELECT event_type, count(*) AS n_predictions, {r('best_score')}, best_score > 50 AS high_error, stddev_pop(yhat) < 1e-6 AS constant, false AS not_finite,
  CASE WHEN best_score > 50 OR stddev_pop(yhat) < 1e-6 THEN 'warning' ELSE 'ok' END AS status, round(avg(yhat), 6) + 0.0 AS mean_yhat FROM c JOIN s USING (event_type) GROUP BY event_type, best_score""".replace(
      r("best_score"), "round(best_score, 6) + 0.0 AS best_score"))
def _(spark, sf):
    keys = ["event_type"]
    final, _ = blend.combine_forecasts(forecasts(spark, sf), scores(spark, sf), keys, "mean_mape", 2)
    flags = blend.forecast_flags(final, scores(spark, sf), keys, "mean_mape")
    return rounded(flags.join(final.groupBy("event_type").agg(F.avg("yhat").alias("mean_yhat")), "event_type"))


# ---- stacking ------------------------------------------------------------------------------

def _long_panel(spark, sf) -> Panel:
    return shipped(spark, sf)


@query("v9_stack_origins", """WITH s AS (SELECT l_returnflag, count(DISTINCT l_shipdate) AS n FROM lineitem GROUP BY 1)
  SELECT l_returnflag, k::BIGINT AS fold, (200 + k * greatest(24, floor((n - 224) / 8)))::BIGINT AS origin FROM s, range(0, 200) k(k) WHERE 200 + k * greatest(24, floor((n - 224) / 8)) + 24 <= n""")
def _(spark, sf):
    return stacking.stack_origins(shipped(spark, sf), H)


@query("v9_meta_features")
def _(spark, sf):
    return rounded(stacking.meta_features(_long_panel(spark, sf), H))


@query("v10_v11_v12_stacking")
def _(spark, sf):
    pairs = stacking.evaluate_stacking(_long_panel(spark, sf), H)
    return rounded(validation.score(pairs, ["model"]))


# ---- explanation and scenarios ------------------------------------------------------------

@query("e2_train_lag_correlations", f"""WITH {IX}, t AS (SELECT *, floor(n * 0.8) AS m FROM ix WHERE idx < floor(n * 0.8)), l AS (SELECT a.event_type, t.l AS lag, a.idx, a.m, a.y, b.y AS z FROM t a
    JOIN (VALUES (1), (6), (12), (24)) t(l) ON true LEFT JOIN t b ON a.event_type = b.event_type AND b.idx = a.idx - t.l)
  SELECT event_type, lag::BIGINT AS lag, round(coalesce(corr(y, z), 0), 6) + 0.0 AS correlation, round(max(y) FILTER (idx = m - lag), 6) + 0.0 AS value FROM l GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(explain.explain_series(hourly(spark, sf), method="classical")["lags"])


_CORR = """sh AS (SELECT l_returnflag, l_shipdate AS ts, sum(l_quantity) AS y, sum(l_extendedprice) / 1e6 AS price, avg(l_discount) AS discount FROM lineitem GROUP BY 1, 2),
  c AS (SELECT l_returnflag, 'price' AS feature, coalesce(corr(price, y), 0) AS correlation FROM sh GROUP BY 1 UNION ALL SELECT l_returnflag, 'discount', coalesce(corr(discount, y), 0) FROM sh GROUP BY 1)"""


@query("e3_feature_correlations", f"WITH {_CORR} SELECT l_returnflag, feature, {r('correlation')} FROM c")
def _(spark, sf):
    return rounded(explain.feature_correlations(shipped(spark, sf)))


def _tree(spark, sf):
    p = shipped(spark, sf)
    return p, fitted(spark, sf, "forest", lambda: trees.fit_feature_trees(p, "forest"))


@query("e4_k3_importance")
def _(spark, sf):
    p, m = _tree(spark, sf)
    return explain.top_features(trees.importance_table(spark, m, "RandomForest"))


@query("e5_shapley")
def _(spark, sf):
    p, m = _tree(spark, sf)
    return rounded(trees.shap_summary(p, m))


@query("e6_reconciliation", f"""WITH {_CORR}, x AS (SELECT l_returnflag, feature, correlation, correlation * correlation * 100 AS shap_pct, CASE WHEN feature = 'price' THEN 90.0 ELSE 10.0 END AS importance_pct FROM c)
  SELECT l_returnflag, feature, round(importance_pct, 6) + 0.0 AS importance_pct, {r('shap_pct', 'correlation')}, CASE WHEN shap_pct > 10 AND abs(correlation) > 0.2 THEN 'direct driver'
  WHEN abs(correlation) < 0.1 AND importance_pct > 5 THEN 'non-linear effect' END AS hint FROM x""")
def _(spark, sf):
    corr = explain.feature_correlations(shipped(spark, sf))
    shares = corr.select("l_returnflag", "feature", (F.col("correlation") * F.col("correlation") * 100).alias("shap_pct"))
    importance = corr.select("feature", F.when(F.col("feature") == "price", 90.0).otherwise(10.0).alias("importance_pct")).distinct()
    return rounded(explain.reconcile(importance, shares, corr, ["l_returnflag"]))


@query("e7_model_lines", f"""WITH {IX} SELECT event_type, 'Naive' AS model, printf('Repeats the latest value, %.2f.', y) AS explanation FROM ix WHERE idx = n - 1
  UNION ALL SELECT DISTINCT event_type, 'SeasonalNaive', 'Repeats the values of 1 day(s) before.' FROM ix UNION ALL SELECT DISTINCT event_type, 'ETS', 'Forecast of the model ETS.' FROM ix""")
def _(spark, sf):
    last = naive.naive(hourly(spark, sf), 1).select("event_type", F.col("yhat").alias("last_value"), F.lit(24).alias("seasonal_period"))
    models = last.withColumn("model", F.explode(F.array(*[F.lit(m) for m in ("Naive", "SeasonalNaive", "ETS")])))
    return explain.describe_models(models).select("event_type", "model", "explanation")


@query("e8_explained_forest")
def _(spark, sf):
    p, m = _tree(spark, sf)
    return rounded(explain.explain_trees(p, m, "RandomForest")["reconciliation"])


@query("x1_future_features")
def _(spark, sf):
    return rounded(whatif.future_features(shipped(spark, sf), H))


@query("x1_forward")
def _(spark, sf):
    p, m = _tree(spark, sf)
    return rounded(whatif.forward(p, m, {"price up": {"price": 0.05}, "price half": {"price": ("multiply", 0.5)}, "no discount": {"discount": ("set", 0.0)}}, H))


@query("x1_impact", f"""WITH {DIX}, s AS (SELECT ts, y AS baseline, CASE s WHEN 'a' THEN y * 1.1 ELSE y END AS changed, s AS scenario FROM daily, (VALUES ('a'), ('b')) v(s)), d AS (SELECT *, round(changed - baseline, 2) AS delta FROM s)
  SELECT scenario, round(avg(delta), 2) AS mean_impact, round(max(abs(delta)), 2) AS max_impact, CASE WHEN abs(avg(delta)) < 0.01 THEN 'warning' ELSE 'ok' END AS status FROM d GROUP BY 1""")
def _(spark, sf):
    d = daily(spark, sf).df.withColumn("scenario", F.explode(F.array(F.lit("a"), F.lit("b"))))
    d = d.withColumn("baseline", F.col("y")).withColumn("changed", F.when(F.col("scenario") == "a", F.col("y") * 1.1).otherwise(F.col("y")))
    d = d.withColumn("delta", F.round(F.col("changed") - F.col("baseline"), 2))
    return whatif.impact(d, [], 12.0).select("scenario", "mean_impact", "max_impact", "status")


_SCENARIOS = {"unchanged": {"price": 0.0}, "same price": {"price": ("multiply", 1.0)}, "unknown": {"weather": 3.0}, "no discount": {"discount": ("set", 0.0)}}


@query("x1_forward_impact", """SELECT DISTINCT l_returnflag, s AS scenario, 0.0::DOUBLE AS mean_impact, 0.0::DOUBLE AS max_impact, 'warning' AS status
  FROM lineitem, (VALUES ('unchanged'), ('same price'), ('unknown')) v(s)""")
def _(spark, sf):
    """A scenario that changes nothing has no impact; one that changes a feature is a row of its own in ``x1_scenarios``."""
    p, m = _tree(spark, sf)
    got = whatif.impact(whatif.forward(p, m, _SCENARIOS, H), p.keys, 12.0)
    return got.where("scenario != 'no discount'").select(*p.keys, "scenario", "mean_impact", "max_impact", "status")


@query("x1_scenarios")
def _(spark, sf):
    p, m = _tree(spark, sf)
    return whatif.impact(whatif.forward(p, m, _SCENARIOS, H), p.keys, 12.0).drop("warnings")


@query("e6_reconciled_forest", f"""WITH {_CORR} SELECT l_returnflag, feature, {r('correlation')}, true AS importance_whole, true AS shares_whole, true AS ordered FROM c""")
def _(spark, sf):
    """Importance and Shapley shares of a fitted forest beside the correlations: both add up to 100 over
    the features (of the model, of each series) but for rounding, and no share is negative."""
    p, m = _tree(spark, sf)
    corr = explain.feature_correlations(p)
    rows = explain.reconcile(trees.importance_table(spark, m, "RandomForest"), trees.shap_summary(p, m), corr, p.keys)
    total = rows.groupBy(*p.keys).agg(F.sum("importance_pct").alias("i"), F.sum("shap_pct").alias("s"), F.least(F.min("importance_pct"), F.min("shap_pct")).alias("low"))
    whole = lambda c: F.abs(F.col(c) - 100) < 0.25
    return rounded(rows.join(total, p.keys).select(*p.keys, "feature", "correlation", whole("i").alias("importance_whole"), whole("s").alias("shares_whole"),
                                                   (F.col("low") >= 0).alias("ordered")))


@query("x2_inverse")
def _(spark, sf):
    p, m = _tree(spark, sf)
    return rounded(whatif.inverse(p, m, {"low": 20.0, "high": 500.0}, bounds={"discount": (0.02, 0.02)}))

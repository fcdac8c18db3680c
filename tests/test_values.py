"""Known values, numpy recomputations, properties and edge cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel import AnalysisSpec, Panel, SeriesSpec
from chronopanel.operators import (anomaly, arima, autocorrelation as ac, blend, decompose, density, explain, isolation_forest, mlp, naive, prep, profile,
                                   quantiles, registry, smoothing, stacking, stationarity, trees, validation, whatif)
from chronopanel.plans.analyze import analyze
from chronopanel.sources import files

Y16 = [10, 12, 11, 13, 12, 11, 10, 12, 95, 11, 13, 12, 10, 11, 12, 13]


def by_time(df):
    return df.toPandas().sort_values("ts", ignore_index=True)


def test_detectors_on_known_series(panel_of):
    p = panel_of({"a": Y16})
    d = by_time(anomaly.detect(p, ["zscore", "mad", "rolling", "iqr", "dbscan"]))
    only8 = [i == 8 for i in range(16)]
    for m in ("zscore", "mad", "iqr", "dbscan"):
        assert list(d[f"flag_{m}"]) == only8
    assert not d["flag_rolling"].any()
    assert d["score_zscore"][8] == pytest.approx(3.868327, abs=1e-6)
    assert d["score_mad"][8] == pytest.approx(55.9835, abs=1e-6)
    assert d["score_iqr"][8] == pytest.approx(64.7, abs=1e-6)
    assert d["score_rolling"][8] == pytest.approx(0.888326, abs=1e-6)
    assert anomaly.mad_statistics(p).first()["threshold"] == pytest.approx(15.007625, abs=1e-6)


def test_statistics_on_known_series(panel_of):
    p = panel_of({"a": Y16})
    assert ac.lag_correlations(p, (1,)).first()["correlation"] == pytest.approx(-0.072293, abs=1e-6)
    assert ac.acf(p).where("lag = 1").first()["acf"] == pytest.approx(-0.071684, abs=1e-6)
    assert profile.trend(p).first()["slope"] == pytest.approx(0.167647, abs=1e-6)
    m = profile.moments(p).first()
    assert (m["mean"], m["std"]) == (pytest.approx(16.75), pytest.approx(20.228384, abs=1e-6))


def test_metrics_and_weights(spark):
    df = spark.createDataFrame([(100.0, 90.0), (110.0, 115.0), (0.0, 5.0), (120.0, 130.0)], "y double, yhat double").withColumn("g", F.lit(1))
    m = validation.score(df, ["g"]).first()
    assert [m[x] for x in ("mape", "mae", "rmse", "smape")] == [pytest.approx(v, abs=1e-5) for v in (7.626263, 7.5, 7.905694, 55.742690)]
    s = spark.createDataFrame([("k", "A", 5.0), ("k", "B", 10.0), ("k", "C", 20.0)], "k string, model string, score double")
    want = {blend.inverse_error: [0.571429, 0.285714, 0.142857], blend.softmax: [0.993307, 0.006693, 0.0], blend.floored_inverse: [0.571429, 0.285714, 0.142857]}
    for fn, w in want.items():
        got = [r["weight"] for r in fn(s, ["k"]).orderBy("model").collect()]
        assert got == [pytest.approx(x, abs=1e-6) for x in w]
    assert [r["weight"] for r in blend.uniform(s, ["k"]).collect()] == [pytest.approx(1 / 3)] * 3
    odd = spark.createDataFrame([("k", "A", 5.0), ("k", "B", None), ("k", "C", float("inf"))], "k string, model string, score double")
    assert sum(r["weight"] for r in blend.inverse_error(odd, ["k"]).collect()) == pytest.approx(1.0)


@pytest.mark.parametrize("n,want", [(200, [50, 92, 134]), (100, [50, 58, 66]), (70, [46])])
def test_folds(panel_of, n, want):
    p = panel_of({"a": range(n)})
    assert [r["origin"] for r in validation.folds(p, 24).orderBy("fold").collect()] == want
    last = validation.folds(p, 24, align="end").orderBy(F.desc("fold")).first()
    assert last["origin"] + last["fold_h"] == n


def test_seasonal_naive_is_exact_on_a_sine(panel_of):
    y = np.sin(2 * np.pi * np.arange(240) / 24)
    p = panel_of({"a": y})
    s = validation.cross_validate(p, naive.seasonal_naive, 24, {"seasonal_period": 24}, context=24).toPandas()
    assert s["mae"].max() < 1e-9


def test_adf_and_kpss_against_numpy(panel_of):
    rng = np.random.default_rng(3)
    walk, noise = np.cumsum(rng.normal(size=300)), rng.normal(size=300)
    p = panel_of({"noise": noise, "walk": walk})
    for y, row in zip((noise, walk), stationarity.adf(p).orderBy("k").collect()):
        dy, best = np.diff(y), None
        top = stationarity.max_lag(len(y))
        for final in (False, True):
            for lag in ([best[1]] if final else range(top + 1)):
                start = lag if final else top
                x = np.column_stack([np.ones(len(dy) - start), y[start:-1], *[dy[start - k:len(dy) - k] for k in range(1, lag + 1)]])
                t = dy[start:]
                beta, *_ = np.linalg.lstsq(x, t, rcond=None)
                rss = ((t - x @ beta) ** 2).sum()
                aic = len(t) * np.log(rss / len(t)) + 2 * x.shape[1]
                if not final and (best is None or aic < best[0]):
                    best = (aic, lag)
        se = math.sqrt(rss / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        assert row["adf_lags"] == best[1]
        assert row["adf_statistic"] == pytest.approx(beta[1] / se, rel=1e-6)
    a, b = stationarity.adf(p).orderBy("k").collect()
    assert a["adf_pvalue"] < 0.01 < b["adf_pvalue"]
    assert stationarity.unit_root_pvalue(-2.86) == pytest.approx(0.05, abs=0.002)
    for y, row in zip((noise, walk), stationarity.kpss(p).orderBy("k").collect()):
        e, n = y - y.mean(), len(y)
        cov, s0, s1 = int(n ** (2 / 9)), e @ e / n, 0.0
        for i in range(1, cov + 1):
            v = e[i:] @ e[:-i] / (n / 2)
            s0, s1 = s0 + v, s1 + i * v
        lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
        spread = (e @ e + 2 * sum((1 - i / (lags + 1)) * (e[i:] @ e[:-i]) for i in range(1, lags + 1))) / n
        assert row["kpss_lags"] == lags
        assert row["kpss_statistic"] == pytest.approx((np.cumsum(e) ** 2).sum() / n ** 2 / spread, rel=1e-9)


def test_arima_finds_an_autoregression(panel_of):
    rng = np.random.default_rng(5)
    y = [0.0]
    for e in rng.normal(size=1500):
        y.append(2 + 0.7 * y[-1] + e)
    p = panel_of({"a": y[100:]})
    fit = arima.fit_arima(p, d=0, max_q=0).first()
    assert fit["p"] >= 1 and abs(fit["beta"][1] - 0.7) < 0.08
    path = [r["yhat"] for r in arima.arima(p, 60, max_q=0, d=0).orderBy("h").collect()]
    assert abs(path[-1] - 2 / 0.3) < 1.0
    trend = panel_of({"a": np.arange(200) * 2.0 + rng.normal(0, 0.1, 200)})
    got = [r["yhat"] for r in arima.arima(trend, 5, 1, 1).orderBy("h").collect()]
    assert np.allclose(got, 400 + 2 * np.arange(5), atol=1.5)


def test_smoothing_follows_trend_and_season(panel_of):
    t = np.arange(240)
    y = 50 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 12)
    p = panel_of({"a": y, "b": y * 2, "short": y[:3]})
    for trend, season in (("add", "add"), ("add", "mul"), ("none", "add")):
        got = smoothing.ets(p, 12, trend, season, 12).where("k = 'a'").orderBy("h").toPandas()
        f = np.arange(240, 252)
        want = 50 + 0.5 * f + 10 * np.sin(2 * np.pi * f / 12)
        assert np.abs(got["yhat"] - want).mean() < (6 if trend == "none" else 3) and not got["fallback"].any()
    assert smoothing.ets(p, 2).where("k = 'short' AND fallback").count() == 2
    start = smoothing._begin(y[:2], np.array([[0.3, 0.1, 0.0]]), "add", "none", 1)
    sse = smoothing._advance([y[:40]], [start], "add", "none", 1)[0]["sse"]
    level, slope, total = y[0], y[1] - y[0], 0.0
    for v in y[:40]:
        fit = level + slope
        total += (v - fit) ** 2
        new = 0.3 * v + 0.7 * fit
        level, slope = new, 0.1 * (new - level) + 0.9 * slope
    assert sse[0] == pytest.approx(total)


def test_stl_recovers_components(panel_of):
    t = np.arange(480)
    season = 5 * np.sin(2 * np.pi * t / 24)
    p = panel_of({"a": 10 + 0.02 * t + season + np.random.default_rng(1).normal(0, 0.2, 480), "short": t[:30]})
    d = by_time(decompose.stl(p, 24).where("k = 'a'"))
    assert np.abs(d["seasonal"] - season).mean() < 0.3
    assert np.abs(d["trend"] - (10 + 0.02 * t)).mean() < 0.3
    assert decompose.stl(p, 24).where("k = 'short' AND resid IS NOT NULL").count() == 0
    assert decompose.seasonal_period(p, (7, 12, 24)).where("k = 'a'").first()["seasonal_period"] in (12, 24)
    s = decompose.strengths(p, 24).where("k = 'a'").first()
    assert s["seasonal_strength"] > 0.9 and s["trend_strength"] > 0.9


def test_density_against_brute_force(spark, panel_of):
    rng = np.random.default_rng(7)
    x = np.round(np.concatenate([rng.normal(0, 1, 150), rng.normal(8, 1, 100), [20, 21, -9], np.full(40, 0.5)]), 2)
    f = np.round(rng.normal(0, 1, len(x)), 2)
    for features, eps in ((None, 0.05), (None, 0.5), ({"f": {"a": f}}, 0.2), ({"f": {"a": f}}, 0.5)):
        p = panel_of({"a": x}, features=features)
        m = np.column_stack([x / x.std()] + ([f / f.std()] if features else []))
        near = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)) <= eps
        core = near.sum(1) >= 5
        noise = ~(near & core[None]).any(1)
        got = by_time(density.dbscan(p, p.df, eps=eps))
        assert list(got["flag_dbscan"]) == list(noise)


def test_forest_flags_the_rare_points(panel_of):
    rng = np.random.default_rng(2)
    y = rng.normal(0, 1, 500)
    y[[50, 250, 400]] = [15, -14, 18]
    d = by_time(isolation_forest.isolation_forest(panel_of({"a": y}), panel_of({"a": y}).df))
    assert set(d["score_iforest"].nlargest(3).index) == {50, 250, 400}
    assert 5 <= d["flag_iforest"].sum() <= 10


def test_trees_shapley_and_recursion(panel_of):
    rng = np.random.default_rng(4)
    t = np.arange(300)
    y = np.sin(2 * np.pi * t / 12) * 10 + rng.normal(0, 0.1, 300)
    p = panel_of({"a": y, "b": y * 100 + 7, "short": y[:5]})
    m = trees.fit_lag_trees(p, "forest", 12, n_estimators=10, max_depth=6)
    got = trees.forecast_lag_trees(p, m, 12).toPandas()
    a = got[got.k == "a"].sort_values("h")["yhat"].to_numpy()
    assert np.abs(a - np.sin(2 * np.pi * np.arange(300, 312) / 12) * 10).mean() < 1.5
    b = got[got.k == "b"].sort_values("h")["yhat"].to_numpy()
    assert np.abs((b - 7) / 100 - a).mean() < 0.5
    assert got[got.k == "short"]["fallback"].all()
    lt = trees.lag_table(p, 12, (), m.scale).where("k = 'a'")
    v = trees.shap_values(m, lt.limit(20), ("k", "ts"))
    total = v.groupBy("k", "ts").agg((F.sum("shap") + F.max("base")).alias("s")).toPandas().sort_values("ts")
    direct = trees.predict_features(m, lt).toPandas().set_index("ts")["yhat"]
    assert np.allclose(total["s"], direct[total["ts"]])


def test_shapley_is_the_average_over_orders():
    from itertools import permutations
    nodes = trees.NodeTable(np.array([0]), np.array([0, 1, -1, -1, -1]), np.array([0.0, 0.0, 0, 0, 0]), np.array([1, 3, -1, -1, -1]), np.array([2, 4, -1, -1, -1]),
                            np.array([0.0, 0, 10, 1, 5]), np.array([10.0, 6, 4, 2, 4]), np.array([1.0]))

    def expect(x, known, at=0):
        if nodes.left[at] < 0:
            return nodes.value[at]
        f, l, r = nodes.feature[at], nodes.left[at], nodes.right[at]
        if f in known:
            return expect(x, known, l if x[f] <= nodes.threshold[at] else r)
        return (nodes.cover[l] * expect(x, known, l) + nodes.cover[r] * expect(x, known, r)) / nodes.cover[at]

    for x in ([-1, -1], [-1, 1], [1, 1]):
        phi, base = trees.shapley(nodes, np.array([x], float))
        want = np.zeros(2)
        for order in permutations(range(2)):
            for i, f in enumerate(order):
                want[f] += (expect(x, order[:i + 1]) - expect(x, order[:i])) / 2
        assert np.allclose(phi[0], want) and base == pytest.approx(expect(x, ()))


def test_network_learns(panel_of):
    y = np.sin(2 * np.pi * np.arange(200) / 12)
    p = panel_of({"a": y})
    net = mlp.fit_mlp(p, 12, 8, 12, 0.02)
    assert net.losses[-1] < net.losses[0] * 0.7
    assert mlp.forecast_mlp(p, net, 3).count() == 3


def test_whatif_and_target(panel_of):
    rng = np.random.default_rng(8)
    a, b = rng.uniform(0, 10, 400), rng.uniform(0, 10, 400)
    p = panel_of({"s": 3 * a + 0.1 * b}, features={"a": {"s": a}, "b": {"s": b}})
    m = trees.fit_feature_trees(p, "forest", n_estimators=10, max_depth=6)
    future = p.df.sparkSession.createDataFrame([("s", h, 5.0, 5.0) for h in range(1, 4)], "k string, h int, a double, b double")
    i = {r["scenario"]: r for r in whatif.impact(whatif.forward(p, m, {"up": {"a": 3}, "none": {"zzz": 1}, "set": {"a": ("set", 5.0)}}, 3, future), ["k"], 10.0).collect()}
    assert 6 < i["up"]["mean_impact"] < 12 and i["none"]["status"] == "warning" and i["set"]["mean_impact"] == 0
    got = {(r["goal"], r["feature"]): r for r in whatif.inverse(p, m, {"g": 20.0, "far": 900.0}, bounds={"b": (5.0, 5.0)}).collect()}
    assert got[("g", "a")]["gap"] < 2 and got[("g", "b")]["recommended"] == 5.0 and got[("far", "a")]["far_from_target"]
    corr = {r["feature"]: r["correlation"] for r in explain.feature_correlations(p).collect()}
    assert corr["a"] > 0.95


def test_search_and_request(panel_of):
    t = np.arange(200)
    p = panel_of({"a": 50 + 10 * np.sin(2 * np.pi * t / 24), "b": 20 + np.cos(2 * np.pi * t / 7)})
    got = registry.train_and_forecast(p, "SeasonalNaive", 24)
    best = {r["k"]: got["params"][r["params_id"]]["seasonal_period"] for r in got["scores"].collect()}
    assert best == {"a": 24, "b": 7}
    out = analyze(p, AnalysisSpec(task="both", horizon=6, models=("Naive", "SeasonalNaive"), explain=True, report=True, period=24), {"SeasonalNaive": [{"seasonal_period": 24}]})
    assert out["final"].count() == 12 and out["report"].count() > 0 and out["anomalies"].count() == 400
    assert len(registry.combinations(p.df.sparkSession, registry.MODELS["Boosted"].grid)) == 10
    assert len(registry.combinations(p.df.sparkSession, registry.MODELS["Boosted"].grid, None)) == 81


def test_stacking_has_no_leak(panel_of):
    t = np.arange(120)
    y = np.sin(t / 3.0) * 5 + t * 0.1
    p = panel_of({"a": y}, features={"f": {"a": np.cos(t / 3.0)}})
    small = {"Network": {"n_lags": 4, "hidden_size": 4, "epochs": 2}, "Boosted_uni": {"n_lags": 4, "n_estimators": 2, "num_leaves": 4}, "RF_combined": {"n_lags": 4, "n_estimators": 2, "max_depth": 3}}
    m = stacking.meta_features(p, 6, small, n_folds=2, least=60).orderBy("fold").toPandas()
    assert list(m["last_value"]) == [pytest.approx(y[o - 1]) for o in m["origin"]]
    assert list(m["y"]) == [pytest.approx(y[o]) for o in m["origin"]]
    assert stacking.MetaLearner("boosted").fit(p.df.sparkSession.createDataFrame(m)).model is None


def test_edge_series(panel_of, spark):
    p = panel_of({"const": [5.0] * 60, "zero": [0.0] * 60, "one": [2.0], "lead": [0.0, None, 0.0, 3.0, 0.0, 4.0], "null": [None] * 5, "two": [1.0, 2.0]})
    trimmed = prep.trim_leading(p)
    n = {r["k"]: r["count"] for r in trimmed.df.groupBy("k").count().collect()}
    assert n == {"const": 60, "zero": 60, "one": 1, "lead": 3, "null": 5, "two": 2}
    clean = prep.drop_missing_target(trimmed)
    assert clean.df.where("k = 'null'").isEmpty()
    v = anomaly.vote(clean)
    assert v.where("is_anomaly").where("k = 'const'").count() == 0
    for f in (stationarity.adf, stationarity.kpss, profile.trend, profile.frequency, ac.lag_correlations, decompose.strengths):
        (f(clean, 24) if f is decompose.strengths else f(clean)).collect()
    assert arima.arima(clean, 2).where("fallback").count() > 0
    assert profile.profile(clean).count() == 5
    with pytest.raises(ValueError):
        prep.require_rows(prep.apply_filters(p.df, [("k", "==", "nope")]))


def test_filters_compare_like_text(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (3, None, 2.0)], "i int, s string, d double")
    ids = lambda *f: sorted(r["i"] for r in prep.apply_filters(df, f).collect())
    assert ids(("i", "==", "2")) == [2] and ids(("s", "!=", "a")) == [2, 3] and ids(("d", "!=", 1.5)) == [2, 3]
    assert ids(("i", "in", [1, 3])) == [1, 3] and ids(("i", "~", 1), ("zz", "==", 1)) == [1, 2, 3] and ids(("d", "<", "1.7"), ("i", ">=", 1)) == [1]


def test_frequency_and_future(spark):
    def freq(step, n=5, unit="HOUR"):
        df = spark.sql(f"SELECT timestamp'2024-01-01 00:00:00' + id * INTERVAL {step} {unit} AS ts, double(id) AS y FROM range({n})")
        return profile.frequency(Panel(df, SeriesSpec())).first()["frequency"]
    assert [freq(1), freq(15, unit="MINUTE"), freq(1, unit="DAY"), freq(1, unit="MONTH"), freq(7, unit="DAY"), freq(1, 2)] == ["h", "15min", "D", "MS", "7D", None]
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + id * INTERVAL 15 MINUTE AS ts, double(id) AS y FROM range(9)")
    f = [str(r["ts"]) for r in prep.future_frame(Panel(df, SeriesSpec()), 2).orderBy("h").collect()]
    assert f == ["2024-01-01 02:15:00", "2024-01-01 02:30:00"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1.0)], "ts string, y double")
    files.write_table(df, str(tmp_path / "a.csv"), "csv")
    files.write_table(df, str(tmp_path / "sub" / "b.parquet"))
    assert files.read_series(spark, str(tmp_path / "a.csv"), "ts").dtypes[0][1].startswith("timestamp")
    assert files.column_names(files.read_series(spark, str(tmp_path / "sub" / "b.parquet"))) == ["ts", "y"]
    assert files.list_data_files(spark, str(tmp_path)).count() >= 2
    with pytest.raises(ValueError):
        files.read_series(spark, "x.xlsx")


def test_model_round_trip(panel_of, tmp_path):
    p = panel_of({"a": np.arange(60.0)})
    m = trees.fit_lag_trees(p, "boosted", 3, n_estimators=2, num_leaves=4)
    m.save(str(tmp_path / "m"))
    again = trees.TreeModel.load(str(tmp_path / "m"))
    a, b = (trees.forecast_lag_trees(p, x, 3).orderBy("h").toPandas() for x in (m, again))
    assert np.allclose(a["yhat"], b["yhat"])


def test_smoothing_uses_the_whole_history(panel_of):
    rng = np.random.default_rng(5)
    late = 10 + np.sin(np.arange(1000) / 4) + rng.normal(0, 0.1, 1000)
    early = np.concatenate([rng.normal(0, 1, 2000).cumsum(), rng.normal(0, 1, 2000)])
    p = panel_of({"a": np.concatenate([early, late]), "b": np.concatenate([np.full(4000, 10.0), late])})
    got = {k: [r["yhat"] for r in smoothing.ets(p, 3, "add", "none").where(f"k = '{k}'").orderBy("h").collect()] for k in "ab"}
    assert not np.allclose(got["a"], got["b"], atol=1e-9)
    short = {k: [r["yhat"] for r in smoothing.ets(p, 3, "add", "none", context=500).where(f"k = '{k}'").orderBy("h").collect()] for k in "ab"}
    assert np.allclose(short["a"], short["b"])


def test_short_series_without_keys_give_fallback_rows(spark):
    from chronopanel import Panel, SeriesSpec
    from chronopanel.operators import trees
    p = Panel(spark.createDataFrame([(1, 5.0), (2, 6.0)], "ts long, y double"), SeriesSpec())
    assert [r["fallback"] for r in arima.arima(p, 2).collect()] == [True, True]
    long = Panel(spark.range(60).selectExpr("id AS ts", "double(id % 7) AS y"), SeriesSpec())
    model = trees.fit_lag_trees(long, "forest", 12, n_estimators=2, max_depth=3)
    assert [r["fallback"] for r in trees.forecast_lag_trees(p, model, 2).collect()] == [True, True]
    assert smoothing.ets(p, 2).where("fallback").count() == 2


def test_isolation_forest_on_equal_rows(spark):
    from chronopanel import Panel, SeriesSpec
    from chronopanel.operators import isolation_forest
    df = spark.range(3000).selectExpr("if(id < 2990, 'a', 'b') AS k", "1L AS ts", "if(id = 7, 50.0, 2.0) AS y")
    got = isolation_forest.isolation_forest(Panel(df, SeriesSpec(keys=("k",))), df, n_trees=20).collect()
    assert len(got) == 3000 and all(0 <= r["score_iforest"] <= 1 for r in got)
    n = [isolation_forest.draw_chances(n, 256, 100) for n in (10, 256, 1_000, 10_000, 10_000_000)]
    mean = [100 - sum(c) for c in n]  # expected trees of a row
    assert mean[:2] == [100, 100] and np.allclose(mean[2:], [51.2, 5.12, 0.00512], rtol=1e-6)


def test_roles_come_from_all_rows(spark):
    df = spark.range(200).selectExpr("if(id < 100, null, 'word') AS late", "if(id < 150, '2024-01-01', 'x') AS mixed", "'2024-02-03' AS day", "cast(null AS string) AS none", "id AS n")
    roles = profile.column_roles(df)
    assert roles == {"datetime": ["day"], "numeric": ["n"], "categorical": ["late", "mixed", "none"]}


def test_filters_that_cannot_compare_raise(spark):
    df = spark.createDataFrame([(1, 2.0)], "i int, d double")
    for f in (("d", ">", "abc"), ("i", "in", [1, "x"]), ("d", "between", ["a", "b"])):
        with pytest.raises(ValueError):
            prep.apply_filters(df, [f])
    assert prep.apply_filters(df, [("none", ">", 1), ("d", "like", 1)]).count() == 1


def test_long_stl_blocks_match_the_whole():
    rng = np.random.default_rng(8)
    n, period = 12_000, 24
    y = np.sin(np.arange(n) * 2 * np.pi / period) * 3 + rng.normal(0, 1, n) + 0.001 * np.arange(n)
    weights = np.where(rng.random(n) < 0.7, 0.0, rng.random(n))
    weights[5_000:5_400] = 0.0  # most of a window without weight: the slope test decides
    weights[5_100::97] = 1.0
    for w in (None, weights):
        trend, seasonal = decompose.stl_pass(y, np.zeros(n), w, period)
        reach = decompose.block_reach(period)
        a, b = 4_997, 7_000
        part = slice(a - reach, b + reach)
        t, s = decompose.stl_pass(y[part], np.zeros(b - a + 2 * reach), None if w is None else w[part], period, a - reach, n)
        assert np.abs(t[reach:-reach] - trend[a:b]).max() < 1e-8 and np.abs(s[reach:-reach] - seasonal[a:b]).max() < 1e-8


def test_a_missing_value_voids_stl_on_both_paths(panel_of):
    y = np.sin(np.arange(400) / 3.0)
    series = {"a": [None if i == 200 else float(v) for i, v in enumerate(y)], "b": y}
    for rows in (10_000, 150):
        d = decompose.stl(panel_of(series, block_rows=rows), 7, 2)
        assert d.where("k = 'a' AND trend IS NOT NULL").count() == 0 and d.where("k = 'b' AND trend IS NULL").count() == 0


def test_staged_panels_are_rebuilt_after_release(spark):
    import __spark_entry__ as entry
    from chronopanel.shared import release
    name, sf = "t1_acf", "/root/testdata/sf0.001"
    before = entry.queries()[name](spark, sf).count()
    release(spark)
    assert entry.queries()[name](spark, sf).count() == before

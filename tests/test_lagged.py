"""Regressions from lagged products against the same regressions on design matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import arima, lagged, stationarity, validation
from chronopanel.operators.gram import solve


def series(n, seed, kind):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n)
    if kind == "ar":
        y = np.zeros(n)
        for t in range(1, n):
            y[t] = 5 + 0.6 * y[t - 1] + e[t] + (0.4 * e[t - 1])
        return y
    return np.cumsum(e) + (0.05 * np.arange(n) if kind == "drift" else 0)


@pytest.mark.parametrize("n,most,start", [(40, 3, 3), (40, 5, 9), (7, 3, 5), (6, 2, 5), (5, 2, 5)])
def test_gram_from_sums(n, most, start):
    z = np.random.default_rng(n + most).normal(size=n)
    c = np.array([z[k:] @ z[:n - k] for k in range(most + 1)])
    rows = [[z[t], 1.0, *[z[t - k] for k in range(1, most + 1)]] for t in range(start, n)]
    x = np.array(rows).reshape(-1, most + 2)
    got = lagged.lagged_gram(c, z.sum(), z[:start], z[-most:], n, most, start)
    np.testing.assert_allclose(got, x.T @ x, atol=1e-11)


def test_nested_residuals():
    x = np.random.default_rng(0).normal(size=(50, 6))
    x[:, 3] = x[:, 1] + x[:, 2]
    g = x.T @ x
    got = lagged.nested_rss(g, 0, [1, 2, 3, 4, 5])
    want = [solve(g, 0, list(range(1, 2 + k)))[1] for k in range(5)]
    np.testing.assert_allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize("cuts", [[199], [10, 11, 50, 199], [0, 1, 2, 150]])
def test_stretches_add_up_to_prefixes(cuts):
    v, lags = np.random.default_rng(1).normal(size=200), (3, 5, 2)
    cells = lagged.stretch_cells(v, np.arange(200), 0, np.array(cuts), lags)
    for end, row in zip(cuts, lagged.prefixes(cells, lags)):
        for d in range(3):
            z = np.diff(v[:end + 1], d) if end + 1 > d else np.zeros(0)
            c, total, s, ss, ws = lagged.level_sums(row, lags, d)
            run = np.cumsum(z)
            np.testing.assert_allclose(c, [z[k:] @ z[:max(len(z) - k, 0)] if len(z) > k else 0.0 for k in range(lags[d] + 1)], atol=1e-9)
            np.testing.assert_allclose([total, s, ss, ws], [z.sum(), run.sum(), run @ run, run @ np.arange(1, len(z) + 1)], atol=1e-8)


def by_hand(y, horizon, max_p, max_q, d):
    """Hannan-Rissanen on design matrices."""
    z, long_ar, reach = np.diff(y, d), arima.LONG_AR, max(max_p, max_q)
    fit = lambda x, t: np.linalg.lstsq(x, t, rcond=None)[0]
    lagged_rows = lambda a, t, k: [a[t - i] for i in range(1, k + 1)]
    at = range(long_ar, len(z))
    phi = fit(np.array([[1.0, *lagged_rows(z, t, long_ar)] for t in at]), z[long_ar:])
    e = np.zeros(len(z))
    for t in at:
        e[t] = z[t] - phi[0] - phi[1:] @ np.array(lagged_rows(z, t, long_ar))
    at, best = range(long_ar + reach, len(z)), None
    target = z[long_ar + reach:]
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            x = np.array([[*([1.0] if d <= 1 else []), *lagged_rows(z, t, p), *lagged_rows(e, t, q)] for t in at]).reshape(len(at), -1)
            beta = fit(x, target) if x.shape[1] else np.zeros(0)
            lead = 1 if d <= 1 else 0
            if not (arima._stable(beta[lead:lead + p]) and arima._stable(-beta[lead + p:])):
                continue
            aic = len(at) * np.log(((target - x @ beta) ** 2).sum() / len(at)) + 2 * (x.shape[1] + 1)
            if best is None or aic < best[0]:
                best = (aic, p, q, beta if lead else np.append(0.0, beta))
    aic, p, q, beta = best
    z, e = list(z), list(e)
    for _ in range(horizon):
        z.append(beta[0] + sum(beta[k] * z[-k] for k in range(1, p + 1)) + sum(beta[p + k] * e[-k] for k in range(1, q + 1)))
        e.append(0.0)
    path = np.array(z[-horizon:])
    if d == 1:
        path = y[-1] + np.cumsum(path)
    if d == 2:
        path = y[-1] + np.cumsum(y[-1] - y[-2] + np.cumsum(path))
    return aic, p, q, path


@pytest.mark.parametrize("d", [0, 1, 2])
def test_arima_equals_design_matrices(panel_of, d):
    data = {k: 1000 + 30 * series(400, i, k) for i, k in enumerate(("ar", "walk", "drift"))}
    p = panel_of(data)
    fits = {r["k"]: r for r in arima.fit_arima(p, 2, 2, d).collect()}
    paths = arima.arima(p, 6, 2, 2, d).toPandas()
    for k, y in data.items():
        aic, ar, ma, path = by_hand(y, 6, 2, 2, d)
        assert (fits[k]["p"], fits[k]["q"]) == (ar, ma)
        assert fits[k]["aic"] == pytest.approx(aic, abs=1e-5)
        np.testing.assert_allclose(paths[paths["k"] == k].sort_values("h")["yhat"], path, rtol=1e-7)


def test_origins_equal_one_series_per_origin(panel_of):
    data = {k: series(n, i, k) for i, (k, n) in enumerate({"ar": 500, "walk": 230, "drift": 90}.items())} | {"flat": np.ones(80), "one": [2.0]}
    for size in (250_000, 60):
        p = panel_of(data, block_rows=size)
        origins = validation.evaluation_origins(p, 3, 0.3, 20)
        a = arima.arima_at(p, origins, 3, 20).toPandas()
        b = arima.arima(validation.origin_panel(p, origins, None, 20), 3).toPandas()
        a, b = (x.sort_values(["k", "origin", "h"], ignore_index=True)[["k", "origin", "h", "yhat", "fallback"]] for x in (a, b))
        assert len(a) == len(b) > 200 and (a["fallback"] == b["fallback"]).all() and not a["fallback"].all()
        np.testing.assert_allclose(a["yhat"], b["yhat"], atol=1e-6)


def test_level_test_of_a_beginning_equals_the_operator(panel_of):
    data = {"ar": series(300, 3, "ar"), "walk": series(300, 4, "walk")}
    p = panel_of(data)
    lags = (20, 20, 20)
    origins = p.df.select("k").distinct().withColumn("origin", F.explode(F.array(F.lit(150).cast("long"), F.lit(299).cast("long"))))
    got = {(r["k"], r["fit_rows"]): r for r in lagged.prefix_sums(p, lags, origins, 2).collect()}
    for o in (150, 299):
        for r in stationarity.kpss(panel_of({k: v[:o] for k, v in data.items()}), "short").collect():
            x = got[r["k"], o]
            z = lambda a: (np.array(a) - x["mean"]) / x["std"]
            assert arima._level_pvalue(np.array(x["cells"]), lags, 0, z(x["head"]), z(x["tail"]), o) == pytest.approx(r["kpss_pvalue"], abs=1e-9)


def test_one_scan_whatever_the_number_of_origins(panel_of):
    p = panel_of({"a": series(400, 1, "walk")})
    p.longest  # measured before
    plans = []
    for most in (2, 40):
        origins = validation.evaluation_origins(p, 2, 0.5, most)
        plan = arima.arima_at(p, origins, 2, most)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode" in plan  # steps and origins only
        plans.append(plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("Relation ["))
    assert plans[0] == plans[1] <= 3  # rows, their scale, the origins


def test_awkward_series(panel_of):
    data = {"nan": [1.0, 2.0, float("nan"), *range(60)], "line": 3.0 + 2.0 * np.arange(80), "flat": [4.0] * 60, "short": [1.0, 2.0, 4.0]}
    p = panel_of(data)
    got = arima.arima(p, 2).toPandas().set_index(["k", "h"])
    assert got.loc[("nan", 1), "fallback"] and got.loc[("nan", 1), "yhat"] == 59
    assert got.loc[("line", 2), "yhat"] == pytest.approx(165.0, abs=1e-6)
    assert got.loc[("flat", 2), "yhat"] == pytest.approx(4.0)
    assert got.loc[("short", 1), "fallback"] and got.loc[("short", 2), "yhat"] == 4.0
    rows = {r["k"]: r["adf_statistic"] for r in stationarity.adf(p).collect()}
    assert rows["flat"] is None and rows["short"] is None and rows["nan"] is None
    assert arima.arima(p.derive(p.df.where("k = 'none'")), 2).count() == 0

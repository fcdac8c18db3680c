"""Series longer than a block give the same results as one ordered window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import anomaly, arima, autocorrelation as ac, decompose, density, isolation_forest, naive, quantiles, smoothing, stationarity, validation


def wave(n, seed=0, period=24):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    y = 20 + 0.01 * t + 5 * np.sin(2 * np.pi * t / period) + rng.normal(0, 1, n)
    y[rng.integers(0, n, max(1, n // 100))] += 25
    return np.round(y, 3)


@pytest.fixture(scope="module")
def pair(panel_of):
    # one hot series, a medium and a tiny one
    series = {"hot": wave(900), "mid": wave(300, 1), "tiny": wave(30, 2), "one": [3.0]}
    return panel_of(series), panel_of(series, block_rows=90)


def same(a, b, by, digits=6):
    a, b = (d.toPandas().sort_values(by, ignore_index=True) for d in (a, b))
    a, b = a[sorted(a.columns)], b[sorted(b.columns)]
    assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=10.0 ** -digits, rtol=1e-7, equal_nan=True)
        else:
            assert [str(x) for x in a[c]] == [str(x) for x in b[c]], c


FOUR = ["zscore", "mad", "rolling", "iqr"]
CASES = {
    "indexed": (lambda p: p.indexed(), ["k", "ts"]),
    "lead_lag": (lambda p: p.over(lambda w: {"a": F.lag("y", 40).over(w), "b": F.lead("y", 7).over(w)}, before=40, after=7), ["k", "ts"]),
    "quantiles": (lambda p: quantiles.quantiles(p, "y", {"a": 0.05, "b": 0.5, "c": 0.75, "d": 1.0}), ["k"]),
    "acf": (lambda p: ac.acf(p, 30), ["k", "lag"]),
    "rolling": (lambda p: ac.rolling(p, 24), ["k", "ts"]),
    "summary": (lambda p: ac.statistical_summary(p), ["k"]),
    "context": (lambda p: ac.context_windows(p).withColumn("y_window", F.col("y_window").cast("string")), ["k", "ts"]),
    "classical": (lambda p: decompose.classical(p, 24), ["k", "ts"]),
    "stl": (lambda p: decompose.stl(p, 7, 3), ["k", "ts"]),
    "kpss": (lambda p: stationarity.kpss(p), ["k"]),
    "kpss_short": (lambda p: stationarity.kpss(p, "short"), ["k"]),
    "adf": (lambda p: stationarity.adf(p), ["k"]),
    "line": (lambda p: density.line_density(p, "y", 0.1, 4), ["k", "y"]),
    "vote": (lambda p: anomaly.vote(p, FOUR, 2), ["k", "ts"]),
    "seasonal_naive": (lambda p: naive.seasonal_naive(p, 30, 24), ["k", "h"]),
    "ets": (lambda p: smoothing.ets(p, 5, "add", "add", 24), ["k", "h"]),
    "ets_multiplicative": (lambda p: smoothing.ets(p, 5, "mul", "mul", 24), ["k", "h"]),
    "ets_fixed": (lambda p: smoothing.ets(p, 5, "add", "add", 12, parameters=(0.3, 0.1, 0.2)), ["k", "h"]),
    "arima": (lambda p: arima.arima(p, 5, 2, 2), ["k", "h"]),
    "folds": (lambda p: validation.cross_validate(p, naive.seasonal_naive, 12, {"seasonal_period": 12}), ["k", "fold"]),
    "folds_context": (lambda p: validation.cross_validate(p, naive.seasonal_naive, 12, {"seasonal_period": 12}, context=12), ["k", "fold"]),
    "isolation": (lambda p: isolation_forest.isolation_forest(p, p.df, n_trees=10).drop("score_iforest"), ["k", "ts"]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_blocks_change_nothing(pair, name):
    fn, by = CASES[name]
    same(fn(pair[0]), fn(pair[1]), by, 5 if name in ("arima", "stl") else 6)


def test_no_block_is_much_larger_than_asked(pair):
    rows, _ = pair[1].blocked(before=10)
    sizes = rows.groupBy("k", "__block").count().agg(F.max("count")).first()[0]
    assert sizes <= 90 + 90 // 4 + 90 // 4 + 10


def test_bursts_and_stray_times_are_cut_too(spark):
    from chronopanel import Panel, SeriesSpec
    # one stray row decades before, and all the rest within seconds
    df = spark.sql("SELECT 'a' AS k, if(id = 0, timestamp'1970-01-01 00:00:00', timestamp'2024-01-01 00:00:00' + id * INTERVAL 1 SECOND) AS ts, double(id) AS y FROM range(2000)")
    p = Panel(df, SeriesSpec(keys=("k",), block_rows=100))
    rows, _ = p.blocked(before=5)
    assert rows.groupBy("__block").count().agg(F.max("count")).first()[0] <= 150
    d = p.over(lambda w: {"a": F.lag("y", 5).over(w)}, before=5)
    assert d.where("idx != y OR (idx >= 5 AND a != y - 5)").count() == 0 and d.count() == 2000
    assert sorted(r["idx"] for r in p.tail(7).collect()) == list(range(1993, 2000))


def test_panel_without_keys(spark, pair):
    from chronopanel import Panel, SeriesSpec
    df = pair[0].df.where("k = 'hot'").select("ts", "y")
    a, b = (Panel(df, SeriesSpec(block_rows=n)) for n in (10_000, 70))
    for fn in (lambda p: ac.rolling(p, 24), lambda p: quantiles.quantiles(p, "y", {"a": 0.3}), lambda p: stationarity.adf(p),
               lambda p: anomaly.vote(p, FOUR, 2), lambda p: naive.seasonal_naive(p, 5, 3)):
        x, y = fn(a), fn(b)
        same(x, y, [c for c in ("ts", "h", "a", "adf_statistic") if c in x.columns])


def test_null_key_is_a_series(spark, pair):
    df = pair[0].df.withColumn("k", F.when(F.col("k") != "mid", F.col("k")))
    a = pair[0].fresh(df, tie=("y",))
    b = pair[0].fresh(df, tie=("y",), block_rows=90)
    assert a.n_series == 4
    assert a.indexed().count() == b.indexed().count() == df.count()

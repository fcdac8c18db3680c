"""Smoothing of long series by composed affine maps: equal to the fold, with a fixed number of jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel import Panel, SeriesSpec
from chronopanel.operators import smoothing, smoothing_scan

import __spark_entry__  # noqa: F401  functions travel by value


def wave(n, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 50 + 0.01 * t + 5 * np.sin(2 * np.pi * t / 12) + rng.normal(size=n)


@pytest.mark.parametrize("trend,seasonal", [("add", "add"), ("none", "add"), ("add", "none"), ("none", "none")])
def test_composed_maps_are_the_fold(trend, seasonal):
    sp, y = 12, wave(500, 1)
    params = smoothing._grid(trend, seasonal, None)
    begin = smoothing._begin(y, params, trend, seasonal, sp)
    cuts = [0, 7, 100, 100, 101, 350, 500]
    lengths = [b - a for a, b in zip(cuts, cuts[1:])]
    m = smoothing_scan.step_matrix(params, trend, seasonal, sp)
    ends = []
    for a, b in zip(cuts, cuts[1:]):
        zero = smoothing_scan.unflat(np.zeros((len(params), m.shape[1])), a, params, seasonal, sp)
        ends.append(smoothing_scan.flat(smoothing._advance([y[a:b]], [zero], trend, seasonal, sp)[0], seasonal, sp))
    starts, last = smoothing_scan.along(lengths, ends, smoothing_scan.flat(begin, seasonal, sp), m)
    states = [begin]
    for a, b in zip(cuts, cuts[1:]):
        states.append(smoothing._advance([y[a:b]], [states[-1]], trend, seasonal, sp)[0])
    stable = np.isfinite(states[-1]["level"]) & (np.abs(states[-1]["level"]) < 1e6)
    assert stable.sum() > len(params) / 2
    for got, state in zip([*starts, last], states):
        np.testing.assert_allclose(got[stable], smoothing_scan.flat(state, seasonal, sp)[stable], rtol=1e-8, atol=1e-8)


def run(p, *args, **more):
    return smoothing.ets(p, 4, *args, **more).orderBy("k", "h").toPandas()


@pytest.mark.parametrize("fan,modes,parameters", [(2, ("add", "add", 12), (0.3, 0.1, 0.2)), (256, ("mul", "mul", 12), None)])
def test_levels_of_the_scan(panel_of, monkeypatch, fan, modes, parameters):
    monkeypatch.setattr(smoothing_scan, "FAN", fan)
    series = {"a": wave(900, 2).tolist(), "b": [None, *wave(400, 3), float("nan")], "short": [1.0, 2.0], "minus": (wave(300, 4) - 60).tolist(), None: wave(200, 5).tolist()}
    short, long = (run(panel_of(series, block_rows=rows), *modes, parameters=parameters) for rows in (10_000, 90))
    assert list(short["k"]) == list(long["k"]) and list(short["fallback"]) == list(long["fallback"])
    np.testing.assert_allclose(long["yhat"], short["yhat"], rtol=1e-6)


def test_a_million_rows(spark, monkeypatch):
    """Whole history in 50 blocks: the forecast of the fold, by as many staged tables as with few blocks."""
    n, sp, fixed = 1_000_000, 24, (0.2, 0.01, 0.1)
    made = []
    real = smoothing_scan.stage
    monkeypatch.setattr(smoothing_scan, "stage", lambda d, name: made.append(name) or real(d, name))
    df = spark.range(n).select(F.lit("a").alias("k"), F.timestamp_seconds("id").alias("ts"),
                               (50 + F.col("id") * 1e-5 + 5 * F.sin(F.col("id") * (2 * np.pi / sp)) + F.hash("id") / 2.0**31).alias("y"))
    y = df.orderBy("ts").toPandas()["y"].to_numpy()
    state = smoothing._begin(y, np.array([fixed]), "add", "add", sp)
    want, _ = smoothing._path(smoothing._least(smoothing._advance([y], [state], "add", "add", sp)[0]), "add", "add", sp, 5, y[-1], False)
    counts = []
    for rows in (20_000, 400_000):
        p = Panel(df, SeriesSpec(time="ts", target="y", keys=("k",), block_rows=rows))
        got = smoothing.ets(p, 5, "add", "add", sp, parameters=fixed).orderBy("h").toPandas()["yhat"]
        counts.append(len(made))
        made.clear()
        np.testing.assert_allclose(got, want, rtol=1e-8)
    assert counts[0] == counts[1]

"""Registered queries do the whole of their work: no smaller models, no part of a grid."""

import numpy as np
import pytest

import __spark_entry__ as entry
from chronopanel.catalog import forecasts
from chronopanel.operators import mlp, naive, registry, trees


@pytest.fixture
def series(panel_of):
    rng = np.random.default_rng(5)
    values = lambda: {k: rng.normal(20, 2, 300) for k in "ab"}
    return panel_of(values(), features={"price": values(), "discount": values()})


class Enough(Exception):
    pass


def fitted_with(monkeypatch, series, name):
    """What the query's first fit of each base model is called with, besides the rows."""
    seen = {}
    def fit_trees(p, kind, **params):
        seen[kind] = params
        if kind == "forest":
            raise Enough
    monkeypatch.setattr(mlp, "fit_mlp", lambda p, **params: seen.update(network=params))
    monkeypatch.setattr(trees, "fit_lag_trees", fit_trees)
    monkeypatch.setattr(forecasts, "shipped", lambda spark, sf: series)
    with pytest.raises(Enough):
        entry.queries()[name](None, "")
    return seen


@pytest.mark.parametrize("name", ["v9_meta_features", "v10_v11_v12_stacking"])
def test_stacking_fits_the_default_base_models(monkeypatch, series, name):
    assert fitted_with(monkeypatch, series, name) == {"network": {}, "boosted": {}, "forest": {"exog": ("price", "discount")}}
    assert mlp.DEFAULTS == {"n_lags": 24, "hidden_size": 64, "epochs": 50, "learning_rate": 0.001}


def test_search_tries_every_combination(spark, monkeypatch, panel_of):
    assert len(registry.candidates(spark, registry.MODELS["RandomForest"])) == 27
    periods = [7, 8, 9, 10, 11, 13, 15, 16, 17, 19, 23]
    p = panel_of({str(s): [20 + (i % s) ** 2 for i in range(130)] for s in periods})
    monkeypatch.setitem(registry.MODELS, "Many", registry.Forecaster("Many", "statistical", grid={"seasonal_period": periods}, series=naive.seasonal_naive, context=30))
    got = registry.train_and_forecast(p, "Many", 24)
    assert {r["k"]: got["params"][r["params_id"]]["seasonal_period"] for r in got["scores"].collect()} == {str(s): s for s in periods}

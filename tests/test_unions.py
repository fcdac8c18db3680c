"""Branches of a union are written one by one, so that no task holds the sorts and tables of all of them."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel import shared
from chronopanel.catalog import data, forecasts
from chronopanel.operators import naive, registry, stacking, validation


@pytest.fixture
def plans(monkeypatch):
    """The plans of everything staged."""
    real, seen = shared.stage, []
    def stage(df, *a, **k):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, *a, **k)
    for m in (shared, data, registry, stacking):
        monkeypatch.setattr(m, "stage", stage)
    return seen


def mixed(plans):
    """Plans with a union whose branches hold more than a scan."""
    found = []
    for plan in plans:
        lines, depth = plan.split("\n"), lambda x: len(re.match(r"[\s:+|-]*", x).group())
        for i, line in enumerate(lines):
            if re.match(r"[\s:+|-]*Union", line):
                below = lines[i + 1:]
                end = next((j for j, x in enumerate(below) if depth(x) <= depth(line)), len(below))
                found += [plan] * any(re.match(r"[\s:+|-]*(Window|Aggregate|Join)", x) for x in below[:end])
    return found


@pytest.fixture
def series(panel_of):
    rng = np.random.default_rng(3)
    return panel_of({k: rng.normal(20, 2, 300) for k in "ab"}, features={"f": {k: rng.normal(0, 1, 300) for k in "ab"}})


def test_union_of_staged_parts_has_their_rows(spark, plans):
    parts = [spark.range(20).groupBy((F.col("id") % 5).alias("k")).agg(F.sum(F.col("id") * m).alias("s")) for m in range(4)]
    got = shared.stage_union(parts)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for p in parts for r in p.collect())
    assert len(plans) == 4 and not mixed(plans)


def test_fold_scores_of_models_are_staged_apart(spark, monkeypatch, plans, series):
    monkeypatch.setattr(forecasts, "hourly", lambda spark, sf: series.derive(series.df.withColumnRenamed("k", "event_type"), keys=("event_type",)))
    monkeypatch.setattr(forecasts, "kept", lambda spark, sf, name, build: shared.stage(build(), name))
    assert forecasts.fold_scores(spark, "").count() == 2 * 4 * 3
    assert forecasts.forecasts(spark, "").count() == 2 * 4 * 24
    assert plans and not mixed(plans)


def test_candidates_are_staged_apart(spark, plans, series):
    q = [{"n_estimators": 1, "max_depth": 2, "n_lags": n} for n in (2, 3)]
    got = registry.search(series.derive(series.df, features=()), registry.MODELS["RandomForest"], 6, q)
    assert got.count() == 2 * 2 * 3
    assert registry.search(series, registry.MODELS["SeasonalNaive"], 6).count() == 2 * 4 * 3
    assert plans and not mixed(plans)


def test_stacking_folds_are_staged_apart(spark, plans, series):
    params = {"Network": {"n_lags": 3, "hidden_size": 4, "epochs": 1}, "Boosted_uni": {"n_lags": 3, "n_estimators": 1, "num_leaves": 2},
              "RF_combined": {"n_lags": 3, "n_estimators": 1, "max_depth": 2}}
    meta = stacking.meta_features(series, 24, params, 2)
    assert {(r.k, r.fold) for r in meta.collect()} == {(k, f) for k in "ab" for f in range(3)}
    assert plans and not mixed(plans)


def test_rolling_origin_models_are_staged_apart(spark, plans, series):
    got = validation.rolling_origin(series, {n: (naive.seasonal_naive, {"seasonal_period": s}, s) for n, s in (("a", 7), ("b", 12))}, 6, max_windows=3)
    assert got.count() == 2 * 2 * 3 * 6
    assert not mixed([*plans, got._jdf.queryExecution().optimizedPlan().toString()])

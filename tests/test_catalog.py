"""Every registered query with SQL gives the rows DuckDB gives."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert difference(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["s4_list_files", "t4_adf", "m3_arima", "m4_ets", "a6_isolation_forest", "x2_inverse"])
def test_rows_only_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_refits_see_the_whole_history_at_all_windows(spark, monkeypatch):
    from chronopanel.catalog import forecasts
    real, seen = forecasts.validation.at_origins, []
    monkeypatch.setattr(forecasts.validation, "at_origins", lambda p, fn, origins, h, q, context, n: seen.append((context, n)) or real(p, fn, origins, h, q, context, n))
    entry.queries()["v7_rolling_origin_refit"](spark, SF)
    assert seen == [(None, 50)] * 2

"""Results do not depend on the session's time zone or on how rows lie in files."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel import Panel, SeriesSpec
from chronopanel.operators import anomaly, autocorrelation, decompose, isolation_forest, stationarity

import __spark_entry__  # noqa: F401  functions travel by value


def panel(spark, block_rows=250_000):
    rng = np.random.default_rng(3)
    # hours around a change of summer time, as microseconds since 1970
    rows = [(k, 1_711_756_800_000_000 + i * 3_600_000_000, float(np.sin(i / 4) * 5 + rng.normal() + 40 * (i == 77))) for k in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts long, y double").withColumn("ts", F.timestamp_micros("ts"))
    return Panel(df.withColumn("since", F.timestamp_micros(F.lit(10**15))), SeriesSpec(time="ts", target="y", keys=("k", "since"), block_rows=block_rows))


def results(spark, block_rows):
    p = panel(spark, block_rows)
    out = {"stl": decompose.stl(p, 24, 1), "forest": isolation_forest.isolation_forest(p, p.df, n_trees=20), "acf": autocorrelation.acf(p, 5), "adf": stationarity.adf(p, 2)}
    if block_rows > 300:
        out["vote"] = anomaly.vote(p)
    return {n: sorted(map(str, d.withColumns({c: F.unix_micros(c) for c, t in d.dtypes if t == "timestamp"}).withColumns(
        {c: F.round(c, 6) for c, t in d.dtypes if t == "double"}).collect())) for n, d in out.items()}


@pytest.mark.parametrize("zone,block_rows", [("Europe/Berlin", 250_000), ("Etc/UTC", 160)])
def test_session_zones(spark, zone, block_rows):
    want = results(spark, block_rows)
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert results(spark, block_rows) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_forest_is_a_function_of_the_rows(spark):
    rng = np.random.default_rng(6)
    rows = [("a", datetime(2024, 1, 1) + timedelta(minutes=i), float(v)) for i, v in enumerate(rng.normal(size=2_000))]
    rows += rows[:50] + [rows[3]] * 400
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, y double")
    got = []
    for parts in (1, 7):
        p = Panel(df.repartition(parts), SeriesSpec(time="ts", target="y", keys=("k",)))
        got.append(sorted(map(tuple, isolation_forest.isolation_forest(p, p.df).collect())))
    assert got[0] == got[1] and len(got[0]) == 2_450

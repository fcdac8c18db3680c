import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def panel_of(spark):
    """Build a panel from {key: [values]} with hourly time stamps."""
    from datetime import datetime, timedelta
    from chronopanel import Panel, SeriesSpec
    start = datetime(2024, 1, 1)

    def build(series, block_rows=250_000, features=None, shuffle=True):
        names = list(features or [])
        rows = []
        for k, values in series.items():
            for i, v in enumerate(values):
                rows.append((k, start + timedelta(hours=i), None if v is None else float(v), *[float(features[f][k][i]) for f in names]))
        schema = "k string, ts timestamp, y double" + "".join(f", {f} double" for f in names)
        df = spark.createDataFrame(rows, schema)
        if shuffle:
            df = df.repartition(5, "y")
        return Panel(df, SeriesSpec(keys=("k",), features=tuple(names), block_rows=block_rows))
    return build

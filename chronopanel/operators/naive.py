"""Naive forecasts.  Every forecaster maps (panel, horizon, params) to (keys, h, yhat, fallback)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .panel import Panel

SEASONAL_PERIOD = 12


def steps(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def naive(p: Panel, horizon: int) -> DataFrame:
    """M1: the last value, repeated."""
    last = p.aggregate(F.max_by(p.y.cast("double"), F.struct(p.spec.time, *p.spec.tie)).alias("yhat"))
    return steps(last, horizon).select(*p.keys, "h", "yhat", F.lit(False).alias("fallback"))


def seasonal_naive(p: Panel, horizon: int, seasonal_period: int = SEASONAL_PERIOD) -> DataFrame:
    """M2: the value of the same place in the last season; the last value if the series is
    shorter than a season."""
    sp = seasonal_period
    tail = p.tail(sp)
    short = F.col("n") < sp
    place = (F.col("idx") - (F.col("n") - sp)).cast("long")  # 0 .. sp-1
    rows = tail.select(*p.keys, short.alias("fallback"), place.alias("__place"), p.y.cast("double").alias("yhat"))
    rows = rows.where(~F.col("fallback") | (F.col("__place") == sp - 1))
    # each place serves the steps h with (h-1) % sp == place: generated, not joined
    first = F.when(F.col("fallback"), F.lit(1)).otherwise(F.col("__place") + 1)
    by = F.when(F.col("fallback"), F.lit(1)).otherwise(F.lit(sp))
    rows = rows.where(first <= horizon)
    return rows.select(*p.keys, F.explode(F.sequence(first.cast("int"), F.lit(horizon), by.cast("int"))).alias("h"), "yhat", "fallback")

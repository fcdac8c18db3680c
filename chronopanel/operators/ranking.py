"""Top rows per series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .panel import Panel


def top_per_series(p: Panel, n: int, by: str, *ties: str, df: DataFrame | None = None) -> DataFrame:
    """The ``n`` rows of each series with the largest ``by``.  The rank limit is also applied
    before the shuffle, so a hot series sends at most ``n`` rows per task."""
    w = Window.partitionBy(*p.keys).orderBy(F.col(by).desc_nulls_last(), *ties)
    d = (p.df if df is None else df).withColumn("rank_no", F.row_number().over(w))
    return d.where(F.col("rank_no") <= n).withColumn("rank_no", F.col("rank_no").cast("long"))

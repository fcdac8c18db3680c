"""Exact quantiles per series, also for series too long for one aggregation buffer.

``percentile`` keeps every distinct value of a group in memory.  That is fine while the
longest series is bounded (measured by the panel).  Beyond it: a mergeable sketch gives cut
points just below and above each wanted quantile, one pass counts the rows between cut points,
and only the rows between the two cut points that enclose a wanted rank are sorted.  The counts
are exact and the intervals cover the whole line, so the result is exact whatever the sketch
error; the sketch only decides how few rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..shared import key_join
from .panel import Panel

SKETCH_ACCURACY = 10_000


def order_statistics(p: Panel, value: str, qs: dict[str, float], df: DataFrame | None = None) -> DataFrame:
    """One row per series: for each name in ``qs`` the order statistics around quantile q,
    ``<name>_lo`` and ``<name>_hi``, and the weight ``<name>_w`` of the upper one."""
    src = (p.df if df is None else df).select(*p.keys, F.col(value).cast("double").alias("__v"))
    src = src.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    if p.longest <= p.spec.block_rows:
        got = src.groupBy(*p.keys).agg(
            F.count(F.lit(1)).alias("__n"),
            F.array_sort(F.collect_list("__v")).alias("__s"))
        return got.select(*p.keys, *[c for name, q in qs.items() for c in (
            F.get("__s", _low(q).cast("int")).alias(f"{name}_lo"),
            F.get("__s", _high(q).cast("int")).alias(f"{name}_hi"),
            _weight(q).alias(f"{name}_w"))])
    return _by_bands(p, src, qs)


def quantiles(p: Panel, value: str, qs: dict[str, float], df: DataFrame | None = None) -> DataFrame:
    """One row per series: linearly interpolated quantiles, named as in ``qs``."""
    src = p.df if df is None else df
    if p.longest <= p.spec.block_rows:
        clean = src.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        return clean.groupBy(*p.keys).agg(
            F.percentile(F.col(value).cast("double"), F.array(*[F.lit(q) for q in qs.values()])).alias("__q")
        ).select(*p.keys, *[F.get("__q", F.lit(i)).alias(name) for i, name in enumerate(qs)])
    st = order_statistics(p, value, qs, df)
    return st.select(*p.keys, *[interpolate(name).alias(name) for name in qs])


def interpolate(name: str, lo=None, hi=None):
    lo = F.col(f"{name}_lo") if lo is None else lo
    hi = F.col(f"{name}_hi") if hi is None else hi
    return lo + (hi - lo) * F.col(f"{name}_w")


def _low(q):
    return F.floor((F.col("__n") - 1) * F.lit(q)).cast("long")


def _high(q):
    return F.least(_low(q) + 1, F.col("__n") - 1)


def _weight(q):
    return (F.col("__n") - 1) * F.lit(q) - _low(q)


def _by_bands(p: Panel, src: DataFrame, qs: dict[str, float]) -> DataFrame:
    keys = p.keys
    margin = 2.0 / SKETCH_ACCURACY
    edges = sorted({min(1.0, max(0.0, q + s)) for q in qs.values() for s in (-margin, margin)})
    sketch = src.groupBy(*keys).agg(
        F.percentile_approx("__v", edges, SKETCH_ACCURACY).alias("__cuts"), F.count(F.lit(1)).alias("__n"))
    band = F.size(F.filter("__cuts", lambda c: c < F.col("__v"))).alias("__band")
    tagged = p.attach(src, sketch).select(*keys, "__v", "__n", band)
    along = Window.partitionBy(*keys).orderBy("__band")
    counts = tagged.groupBy(*keys, "__band").agg(F.count(F.lit(1)).alias("__c"), F.min("__n").alias("__n"))
    counts = counts.withColumn("__start", F.sum("__c").over(along) - F.col("__c"))
    ranks = F.array_distinct(F.array(*[f(q) for q in qs.values() for f in (_low, _high)]))
    hit = F.exists(ranks, lambda r: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__c")))
    wanted = counts.where(hit).select(*keys, "__band", "__start")
    # at most two bands per wanted quantile and series
    if p.n_series * 2 * len(qs) <= 40_000:
        wanted = F.broadcast(wanted)
    inside = key_join(tagged, wanted, [*keys, "__band"])
    values = inside.groupBy(*keys, "__band", "__v").agg(
        F.count(F.lit(1)).alias("__c"), F.min("__start").alias("__start"), F.min("__n").alias("__n"))
    sorted_band = Window.partitionBy(*keys, "__band").orderBy("__v")
    values = values.withColumn("__from", F.col("__start") + F.sum("__c").over(sorted_band) - F.col("__c"))
    holds = lambda r: (r >= F.col("__from")) & (r < F.col("__from") + F.col("__c"))
    picked = values.where(F.exists(ranks, holds))
    aggs = []
    for name, q in qs.items():
        aggs += [F.max(F.when(holds(_low(q)), F.col("__v"))).alias(f"{name}_lo"),
                 F.max(F.when(holds(_high(q)), F.col("__v"))).alias(f"{name}_hi"),
                 F.max(_weight(q)).alias(f"{name}_w")]
    return picked.groupBy(*keys).agg(*aggs)

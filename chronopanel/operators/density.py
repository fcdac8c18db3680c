"""Density clustering (DBSCAN noise), exact at every size."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, functions as F

from ..shared import key_join, stage
from .panel import Panel

EPS = 0.5
MIN_SAMPLES = 5


def dbscan(p: Panel, df: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES, columns=None) -> DataFrame:
    """``flag_dbscan`` = noise of the standardized columns (target and features)."""
    cols = list(columns or (p.spec.target, *p.spec.features))
    noise = (_line_noise if len(cols) == 1 else _grid_noise)(p, cols, eps, min_samples)
    noise = noise.select(*p.keys, *cols, F.lit(True).alias("__noise"))
    out = key_join(df, noise, [*p.keys, *cols], "left")
    flag = F.coalesce("__noise", F.lit(False))
    return out.select("*", flag.cast("double").alias("score_dbscan"), flag.alias("flag_dbscan")).drop("__noise")


def _scale(p: Panel, cols) -> DataFrame:
    return p.aggregate(*[F.stddev_pop(F.col(c).cast("double")).alias(f"__s{i}") for i, c in enumerate(cols)])


def line_density(p: Panel, column: str, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """One row per distinct value: multiplicity ``c``, ``core``, ``noise``, ``starts`` (first
    core value of a cluster).

    In sorted order a point has min_samples neighbours within eps only if enough of the
    ``min_samples - 1`` nearest distinct values on either side are within eps.  The nearest core
    point of a border point and the previous core point of a cluster are that near too, since a
    longer run of points within eps would itself be core.  So fixed row frames decide it all.
    """
    reach = min_samples - 1
    v = F.col("__v")
    values = p.df.select(*p.keys, F.col(column).alias("__raw"), F.col(column).cast("double").alias("__v"))
    values = values.groupBy(*p.keys, "__raw", "__v").agg(F.count(F.lit(1)).alias("c"))
    values = p.attach(values, _scale(p, [column]))
    unit = F.when(F.col("__s0") == 0, 1.0).otherwise(F.col("__s0"))
    q = p.derive(values)
    near = lambda other: F.abs((other - v) / unit) <= eps

    def core(w):
        total = F.col("c")
        for j in range(1, reach + 1):
            for f in (F.lag, F.lead):
                other = f(v, j).over(w)
                total = total + F.when(near(other), f(F.col("c"), j).over(w)).otherwise(0)
        return {"core": total >= min_samples}

    def reachable(w):
        hits, back = F.col("core"), F.lit(False)
        for j in range(1, reach + 1):
            for f in (F.lag, F.lead):
                got = F.coalesce(f(F.col("core"), j).over(w) & near(f(v, j).over(w)), F.lit(False))
                hits = hits | got
                back = back | got if f is F.lag else back
        return {"noise": ~hits, "starts": F.col("core") & ~back}

    out = q.over(core, reachable, before=2 * reach, after=2 * reach, order="__v", tie=())
    return out.select(*p.keys, F.col("__raw").alias(column), "c", "core", "noise", "starts")


def _line_noise(p: Panel, cols, eps: float, min_samples: int) -> DataFrame:
    return line_density(p, cols[0], eps, min_samples).where("noise")


def line_summary(p: Panel, column: str, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Rows that are core / noise and the number of clusters, per series."""
    d = line_density(p, column, eps, min_samples)
    rows = lambda flag: F.sum(F.when(F.col(flag), F.col("c")).otherwise(0)).alias(f"n_{flag}")
    return d.groupBy(*p.keys).agg(rows("core"), rows("noise"), F.sum(F.col("starts").cast("long")).alias("n_clusters"))


def grid_density(p: Panel, cols, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """One row per distinct point that lies in a thin cell: ``core`` and ``noise``.

    Cells have side eps/sqrt(d), so all points of one cell are neighbours: a cell with
    min_samples points is core as a whole and is never compared with itself.  Only points of
    thin cells (fewer than min_samples points each) look around.  Neighbour cells are found by
    an equi-join on the cell of the first (at most three) dimensions; a thin point meets the
    distinct points of those cells, its matches are summed map-side, and nothing is paired
    between two dense cells.
    """
    d = len(cols)
    names = [f"__x{i}" for i in range(d)]
    raw = [f"__r{i}" for i in range(d)]
    pts = p.df.groupBy(*p.keys, *[F.col(c).alias(r) for c, r in zip(cols, raw)]).agg(F.count(F.lit(1)).alias("__c"))
    pts = p.attach(pts, _scale(p, cols))
    unit = lambda i: F.when(F.col(f"__s{i}") == 0, 1.0).otherwise(F.col(f"__s{i}"))
    pts = pts.select(*p.keys, *raw, "__c", *[(F.col(r).cast("double") / unit(i)).alias(names[i]) for i, r in enumerate(raw)])
    side = eps / math.sqrt(d)
    fine = [f"__f{i}" for i in range(d)]
    pts = pts.select("*", *[F.floor(F.col(x) / side).cast("long").alias(f) for x, f in zip(names, fine)])
    # staged: two passes below compare these points with each other by their computed cells
    pts = stage(pts, "density")
    cells = pts.groupBy(*p.keys, *fine).agg(F.sum("__c").alias("__cell"))
    thin_cells = cells.where(F.col("__cell") < min_samples).select(*p.keys, *fine, F.lit(True).alias("__thin"))
    marked = key_join(pts, thin_cells, [*p.keys, *fine], "left").withColumn("__thin", F.coalesce("__thin", F.lit(False)))
    axes = min(d, 3)
    coarse = [f"__g{i}" for i in range(axes)]
    cell = lambda i: F.floor(F.col(names[i]) / eps).cast("long")
    others = marked.select(*p.keys, *[cell(i).alias(coarse[i]) for i in range(axes)], "__thin",
                           *[F.col(x).alias(f"__o{i}") for i, x in enumerate(names)], F.col("__c").alias("__oc"))
    shifts = F.explode(F.array(*[F.struct(*[F.lit(s).alias(f"s{i}") for i, s in enumerate(o)])
                                 for o in product((-1, 0, 1), repeat=axes)])).alias("__s")
    seek = marked.where("__thin").select(*p.keys, *raw, *names, shifts)
    seek = seek.select(*p.keys, *raw, *names, *[(cell(i) + F.col(f"__s.s{i}")).alias(coarse[i]) for i in range(axes)])
    gap = reduce(lambda a, b: a + b, [(F.col(names[i]) - F.col(f"__o{i}")) * (F.col(names[i]) - F.col(f"__o{i}")) for i in range(d)])
    pairs = key_join(seek, others, [*p.keys, *coarse]).where(F.sqrt(gap) <= eps)
    around = pairs.groupBy(*p.keys, *raw, *names).agg(
        F.sum("__oc").alias("__n"), F.bool_or(~F.col("__thin")).alias("__dense"))
    around = around.withColumn("core", F.col("__n") >= min_samples)
    thin = stage(around.select(*p.keys, *raw, *names, "core", "__dense"), "density-thin")
    # a non-core point without a dense neighbour still needs the thin core points around it
    lone = thin.where(~F.col("core") & ~F.col("__dense")).select(*p.keys, *raw, *names, shifts)
    lone = lone.select(*p.keys, *raw, *names, *[(cell(i) + F.col(f"__s.s{i}")).alias(coarse[i]) for i in range(axes)])
    thin_core = thin.where("core").select(*p.keys, *[cell(i).alias(coarse[i]) for i in range(axes)],
                                          *[F.col(x).alias(f"__o{i}") for i, x in enumerate(names)])
    saved = key_join(lone, thin_core, [*p.keys, *coarse]).where(F.sqrt(gap) <= eps).select(*p.keys, *raw, F.lit(True).alias("__saved")).distinct()
    out = key_join(thin, saved, [*p.keys, *raw], "left")
    return out.select(*p.keys, *[F.col(r).alias(c) for c, r in zip(cols, raw)], "core",
                      (~F.col("core") & ~F.col("__dense") & F.col("__saved").isNull()).alias("noise"))


def _grid_noise(p: Panel, cols, eps: float, min_samples: int) -> DataFrame:
    return grid_density(p, cols, eps, min_samples).where("noise")

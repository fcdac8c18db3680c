"""Clusters of DBSCAN over several columns: distributed components over grid cells.

All core points of a grid cell (side eps / sqrt(d)) are in one cluster, so the cells that hold core points are the
nodes, and two cells are linked if a core point of the one lies within eps of one of the other. Points of two cells
are never paired with each other as a whole: cells are cut into smaller boxes, and a box sends one of its points.
Two such points within eps link their cells; two that are further apart than eps plus the boxes' diagonals rule the
pair of boxes out; what is left undecided, and whose cells are not in one cluster yet, is cut again. Boxes of one
point decide exactly, so the recursion ends, after at most ``LEVELS`` cuts by comparing the points themselves.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, Window, functions as F

from ..shared import key_join, stage
from .components import components
from .density import EPS, MIN_SAMPLES, _scale, grid_density
from .panel import Panel

#: a box is cut into this many along each axis, at most so often
CUT, LEVELS = 4, 6


def _points(p: Panel, cols, eps: float, min_samples: int) -> DataFrame:
    """Every distinct point: raw columns, scaled columns, rows, core and noise."""
    unit = lambda i: F.when(F.col(f"__s{i}") == 0, 1.0).otherwise(F.col(f"__s{i}"))
    pts = p.attach(p.df.groupBy(*p.keys, *cols).agg(F.count(F.lit(1)).alias("__c")), _scale(p, cols))
    pts = pts.select(*p.keys, *cols, "__c", *[(F.col(c).cast("double") / unit(i)).alias(f"__x{i}") for i, c in enumerate(cols)])
    # a point of a cell with enough points is core and is not listed there
    known = grid_density(p, cols, eps, min_samples)
    return key_join(pts, known, [*p.keys, *cols], "left").withColumn("core", F.coalesce("core", F.lit(True))).withColumn("noise", F.coalesce("noise", F.lit(False)))


def _gap(left: str, right: str, d: int):
    return F.sqrt(reduce(lambda a, b: a + b, [(F.col(f"{left}.__x{i}") - F.col(f"{right}.__x{i}")) * (F.col(f"{left}.__x{i}") - F.col(f"{right}.__x{i}")) for i in range(d)]))


def _boxes(core: DataFrame, keys, d: int, side: float, kept: list[str]) -> DataFrame:
    """One point (struct ``at``) and the number of points of each box of the given side in each cell."""
    box = F.xxhash64("cell", *[F.floor(F.col(f"__x{i}") / side).cast("long") for i in range(d)])
    return core.withColumn("box", box).groupBy(*keys, "cell", "box", *kept).agg(F.min(F.struct(*[f"__x{i}" for i in range(d)])).alias("at"), F.count(F.lit(1)).alias("size"))


def _near(left: DataFrame, right: DataFrame, keys, d: int, reach: float) -> DataFrame:
    """Pairs of rows (structs ``a`` and ``b``) of one series that may lie within ``reach``: an equi-join on the cells
    of the first (at most three) dimensions."""
    axes = min(d, 3)
    place = lambda side, i: F.floor(F.col(f"{side}.at.__x{i}") / reach).cast("long")
    shifts = F.explode(F.array(*[F.struct(*[F.lit(s).cast("long").alias(f"s{i}") for i, s in enumerate(o)]) for o in product((-1, 0, 1), repeat=axes)]))
    a = left.select(*keys, F.struct(*[c for c in left.columns if c not in keys]).alias("a")).select("*", shifts.alias("s"))
    a = a.select(*keys, "a", *[(place("a", i) + F.col(f"s.s{i}")).alias(f"__g{i}") for i in range(axes)])
    b = right.select(*keys, F.struct(*[c for c in right.columns if c not in keys]).alias("b"))
    b = b.select(*keys, "b", *[place("b", i).alias(f"__g{i}") for i in range(axes)])
    return key_join(a, b, [*keys, *[f"__g{i}" for i in range(axes)]])


def cluster_points(p: Panel, cols=None, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """A7, several columns: every distinct point with its rows ``c``, ``core``, ``noise`` and ``cluster``: 0, 1, ... in
    the order of the least core points of a series, null for noise. A border point belongs to the first of the clusters
    whose core points it touches.

    Cells are named by 64 bits of a hash. Columns must not be null."""
    cols = list(cols or (p.spec.target, *p.spec.features))
    keys, d = p.keys, len(cols)
    xs = [f"__x{i}" for i in range(d)]
    side = eps / math.sqrt(d)
    cell = F.xxhash64(*keys, *[F.floor(F.col(x) / side).cast("long") for x in xs])
    points = stage(_points(p, cols, eps, min_samples).withColumn("cell", cell), "points")
    core = points.where("core")
    gap = F.sqrt(reduce(lambda a, b: a + b, [(F.col(f"a.at.{x}") - F.col(f"b.at.{x}")) * (F.col(f"a.at.{x}") - F.col(f"b.at.{x}")) for x in xs]))

    links = None
    group = core.select("cell").distinct().select("cell", F.col("cell").alias("group"))
    open_ = None  # pairs of boxes still undecided
    for level in range(1, LEVELS + 2):
        exact = level > LEVELS
        width = side / CUT ** level
        slack = 0.0 if exact else 2 * width * math.sqrt(d)
        # where a pair is undecided, its boxes are cut on; at the last level points stand for themselves
        inside = core if open_ is None else core.withColumn("parent", F.xxhash64("cell", *[F.floor(F.col(x) / (width * CUT)).cast("long") for x in xs]))
        kept = [] if open_ is None else ["parent"]
        if exact:
            boxes = inside.select(*keys, "cell", F.xxhash64(*xs).alias("box"), *kept, F.struct(*xs).alias("at"), F.lit(1).cast("long").alias("size"))
        else:
            boxes = _boxes(inside, keys, d, width, kept)
        if open_ is None:
            boxes = stage(boxes, "boxes")
            pairs = _near(boxes, boxes, keys, d, eps + slack)
        else:
            left = boxes.select(*keys, F.col("parent").alias("pa"), F.struct("cell", "box", "at", "size").alias("a"))
            right = boxes.select(F.col("parent").alias("pb"), F.struct("cell", "box", "at", "size").alias("b"))
            pairs = open_.join(left, "pa").join(right, "pb")
        pairs = pairs.where(F.col("a.cell") < F.col("b.cell")).withColumn("gap", gap).where(F.col("gap") <= eps + slack)
        pairs = stage(pairs.select(F.col("a.cell").alias("ca"), F.col("b.cell").alias("cb"), F.col("a.box").alias("pa"), F.col("b.box").alias("pb"), "gap",
                                   ((F.col("a.size") > 1) | (F.col("b.size") > 1)).alias("more")), "pairs")
        sure = pairs.where(F.col("gap") <= eps).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        links = stage(sure if links is None else links.union(sure), "links")
        joined = components(links)
        group = core.select("cell").distinct().join(joined.withColumnRenamed("node", "cell"), "cell", "left").select("cell", F.coalesce("root", "cell").alias("group"))
        group = stage(group, "groups")
        mine = group.select(F.col("cell").alias("ca"), F.col("group").alias("ga"))
        other = group.select(F.col("cell").alias("cb"), F.col("group").alias("gb"))
        left_open = pairs.where((F.col("gap") > eps) & F.col("more")).join(mine, "ca").join(other, "cb").where("ga <> gb")
        open_ = stage(left_open.select("pa", "pb").distinct(), "open")
        if exact or open_.isEmpty():
            break

    named = stage(core.join(group, "cell"), "core")
    first = named.groupBy(*keys, "group").agg(F.min(F.struct(*xs)).alias("first"))
    order = Window.partitionBy(*keys).orderBy("first")  # one row for each cluster of a series
    ranks = first.select(*keys, "group", (F.row_number().over(order) - 1).cast("long").alias("cluster"))
    named = stage(key_join(named, ranks, [*keys, "group"]), "named")
    border = points.where("NOT core AND NOT noise")
    at = F.struct(*xs).alias("at")
    touch = _near(border.select(*keys, F.struct(*cols).alias("raw"), at), named.select(*keys, "cluster", at), keys, d, eps).where(gap <= eps)
    touch = touch.groupBy(*keys, F.col("a.raw").alias("raw")).agg(F.min("b.cluster").alias("cluster"))
    touch = touch.select(*keys, *[F.col(f"raw.{c}").alias(c) for c in cols], "cluster")
    done = named.select(*keys, *cols, "cluster").union(touch.select(*keys, *cols, "cluster"))
    out = key_join(points, done, [*keys, *cols], "left")
    return out.select(*keys, *cols, F.col("__c").alias("c"), "core", "noise", "cluster")


def cluster_summary(p: Panel, cols=None, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Rows that are core / noise and the number of clusters, per series."""
    d = cluster_points(p, cols, eps, min_samples)
    rows = lambda flag: F.sum(F.when(F.col(flag), F.col("c")).otherwise(0)).alias(f"n_{flag}")
    return d.groupBy(*p.keys).agg(rows("core"), rows("noise"), (F.coalesce(F.max("cluster"), F.lit(-1)) + 1).alias("n_clusters"))

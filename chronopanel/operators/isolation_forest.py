"""Isolation forest per series: trees grown in parallel from hashed samples, rows scored in
bounded groups beside the trees of their series."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..shared import as_micros, from_micros, stage
from .panel import Panel
from .quantiles import quantiles

SAMPLE = 256
TREES = 100
CONTAMINATION = 0.02
GROUP_ROWS = (50_000, 500_000)  # rows scored together; towards the upper bound in long series
EULER = 0.5772156649015329


def path_scale(n):
    """Mean depth of an unsuccessful search among n values."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, limit: int):
    """One isolation tree as lists: feature, threshold, left, right, depth (leaf: depth + scale)."""
    feature, threshold, left, right, depth = [], [], [], [], []
    todo = [(x, 0, -1, False)]
    while todo:
        rows, level, parent, is_right = todo.pop()
        me = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = me
        for a, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (depth, level + float(path_scale(len(rows))))):
            a.append(v)
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(hi > lo)
        if level >= limit or len(rows) <= 1 or not len(varied):
            continue
        f = int(rng.choice(varied))
        cut = float(min(rng.uniform(lo[f], hi[f]), np.nextafter(hi[f], lo[f])))
        feature[me], threshold[me] = f, cut
        side = rows[:, f] <= cut
        todo.append((rows[~side], level + 1, me, True))
        todo.append((rows[side], level + 1, me, False))
    return feature, threshold, left, right, depth


def draw_chances(n: int, sample: int, n_trees: int) -> list[float]:
    """P(a row is in at most k of the pools), k = 0 .. n_trees - 1, if each pool takes it independently with
    the chance that makes pools of about twice the sample."""
    q = min(1.0, 2.0 * sample / max(n, 1))
    if n <= sample or q >= 1:
        return [0.0] * n_trees
    lg, out, total = math.lgamma, [], 0.0
    for k in range(n_trees):
        total += math.exp(lg(n_trees + 1) - lg(k + 1) - lg(n_trees - k + 1) + k * math.log(q) + (n_trees - k) * math.log1p(-q))
        out.append(total)
    return out


def fit_forest(p: Panel, columns, n_trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """One row per (series, tree) with the node arrays.

    Every tree draws about twice its sample by hash and keeps ``sample`` rows of it.  In how many trees a
    row is, one hash says (inverse binomial, the same rule at every length); in which, a second one.  Rows equal
    in time and values are numbered, so they are drawn like any others and the forest depends on the rows only."""
    size = p.aggregate(F.count(F.lit(1)).alias("__n"))
    chances = T.StructType([*size.schema.fields, T.StructField("__chances", T.ArrayType(T.DoubleType()))])

    def spread(batches):
        for b in batches:
            yield b.assign(__chances=[draw_chances(int(n), sample, n_trees) for n in b["__n"]])

    xs = [f"__x{i}" for i in range(len(columns))]
    rows = p.df.select(*p.keys, p.spec.time, *p.spec.tie, *[F.col(c).cast("double").alias(x) for c, x in zip(columns, xs)])
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__copies")).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies")))
    rows = rows.withColumn("__h", F.xxhash64("__copy", p.spec.time, *p.spec.tie, *xs)).drop("__copies", "__copy")
    rows = p.attach(rows, size.mapInPandas(spread, chances), cells=n_trees + 1)
    unit = F.pmod(F.xxhash64("__h", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    times = F.size(F.filter("__chances", lambda c: c <= F.col("__u")))
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.struct(F.xxhash64("__h", t).alias("r"), t.alias("t"))))
    which = F.transform(F.slice(ranked, 1, F.col("__times")), lambda r: r["t"])
    rows = rows.withColumn("__u", unit).where(F.col("__u") >= F.col("__chances")[0]).withColumn("__times", times)
    drawn = rows.select(*p.keys, *xs, "__n", "__h", F.explode(which).alias("tree"))
    ints, reals = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())
    schema = T.StructType([*as_micros(drawn.select(*p.keys)).schema.fields, T.StructField("tree", T.IntegerType()), T.StructField("psi", T.IntegerType()),
                           T.StructField("feature", ints), T.StructField("threshold", reals), T.StructField("left", ints),
                           T.StructField("right", ints), T.StructField("depth", reals)])
    keys, width = p.keys, len(columns)

    def run(table: pa.Table) -> pa.Table:
        t = table["tree"][0].as_py()
        x = np.column_stack([table[f"__x{i}"].to_numpy(zero_copy_only=False) for i in range(width)])
        h = table["__h"].to_numpy(zero_copy_only=False).astype(np.uint64)
        order = np.argsort(h * np.uint64(2 * t + 1), kind="stable")[:sample]
        x = x[order]
        nodes = grow(x, np.random.default_rng(42 + t), max(1, math.ceil(math.log2(max(len(x), 2)))))
        out = table.select([*keys, "tree"]).slice(0, 1).append_column("psi", pa.array([len(x)], pa.int32()))
        for name, col, kind in zip(("feature", "threshold", "left", "right", "depth"), nodes,
                                   (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64())):
            out = out.append_column(name, pa.array([col], pa.list_(kind)))
        return out

    return from_micros(as_micros(drawn).groupBy(*p.keys, "tree").applyInArrow(run, schema), drawn.select(*p.keys))


def isolation_forest(p: Panel, df: DataFrame, contamination: float = CONTAMINATION, n_trees: int = TREES, columns=None) -> DataFrame:
    """Score 2^(-mean depth / c); flagged strictly above the (1 - contamination) quantile."""
    cols = list(columns or (p.spec.target, *p.spec.features))
    forest = stage(fit_forest(p, cols, n_trees), "forest")
    n = F.count(F.lit(1))
    size = p.aggregate(F.ceil(n / F.greatest(F.lit(GROUP_ROWS[0]), F.least(F.lit(GROUP_ROWS[1]), n / 4096))).cast("int").alias("__groups"))
    spread = F.pmod(F.xxhash64(p.spec.time, *p.spec.tie), F.col("__groups")).cast("int")
    rows = as_micros(p.attach(df, size).withColumn("__group", spread).drop("__groups"))
    copies = as_micros(p.attach(forest, size)).withColumn("__group", F.explode(F.sequence(F.lit(0), F.col("__groups") - 1))).drop("__groups")
    schema = T.StructType([*as_micros(df).schema.fields, T.StructField("score_iforest", T.DoubleType())])
    names = df.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x = np.column_stack([left[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in cols])
        if not right.num_rows:  # a series without a tree
            return left.select(names).append_column("score_iforest", pa.array(np.full(len(x), 0.5)))
        trees = right.sort_by("tree").to_pydict()
        depth = np.zeros(len(x))
        for f, thr, lo, hi, d in zip(*(trees[k] for k in ("feature", "threshold", "left", "right", "depth"))):
            f, thr, lo, hi = np.array(f), np.array(thr), np.array(lo), np.array(hi)
            at = np.zeros(len(x), int)
            while True:
                inner = f[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= thr[at]
                at = np.where(inner, np.where(go, lo[at], hi[at]), at)
            depth += np.array(d)[at]
        scale = float(path_scale(max(trees["psi"])))
        mean = depth / max(len(trees["psi"]), 1)
        score = np.power(2.0, -mean / scale) if scale > 0 else np.zeros(len(x))
        return left.select(names).append_column("score_iforest", pa.array(score))

    by = [*p.keys, "__group"]
    scored = stage(from_micros(rows.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(run, schema), df), "iforest")
    cut = quantiles(p, "score_iforest", {"__cut": 1 - contamination}, scored)
    out = p.attach(scored, cut)
    return out.withColumn("flag_iforest", F.col("score_iforest") > F.col("__cut")).drop("__cut")

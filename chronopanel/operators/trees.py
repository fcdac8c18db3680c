"""Tree forecasters: Spark ML fits over the whole panel, node tables for recursive forecasts.

Targets are standardized per series, so one model serves series of different scale; for a single
series this changes nothing, since trees do not depend on shift and scale."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.scalar import present
from ..shared import key_join, scratch_dir, send, stage
from .autocorrelation import lag_matrix
from .naive import naive
from .panel import Panel
from .smoothing import tail_arrays

SEED = 42
FOREST_DEFAULTS = {"n_estimators": 100, "max_depth": 10}
BOOSTED_DEFAULTS = {"num_leaves": 31, "learning_rate": 0.1, "n_estimators": 100}
LAGS = 12
CELLS = 2_000_000  # numbers of one intermediate table inside a task


@dataclass
class NodeTable:
    """The nodes of all trees, one tree after the other (as many entries as there are nodes): children are
    positions in these arrays, -1 for a leaf.  The size is set by the tree parameters."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    weight: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._predict(part) for part in pieces(x, len(self.root))])

    def _predict(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.root[None, :], len(x), axis=0)
        row, tree = np.nonzero(self.left[at] >= 0)
        while len(row):  # only the pairs of row and tree that have not reached a leaf
            here = at[row, tree]
            low = x[row, self.feature[here]] <= self.threshold[here]
            step = np.where(low, self.left[here], self.right[here])
            at[row, tree] = step
            inner = self.left[step] >= 0
            row, tree = row[inner], tree[inner]
        return self.value[at] @ self.weight


def pieces(x: np.ndarray, width: int) -> list[np.ndarray]:
    """The rows of ``x`` in chunks whose tables of ``width`` columns stay small; at least one."""
    size = max(1, CELLS // max(1, width))
    return [x[i:i + size] for i in range(0, max(1, len(x)), size)]


@dataclass
class TreeModel:
    kind: str  # forest | boosted
    mode: str  # lags | features | both
    columns: list[str]
    n_lags: int
    exog: list[str]
    ml: object
    scale: DataFrame | None
    nodes: NodeTable
    importances: dict[str, float] = field(default_factory=dict)

    def save(self, path: str) -> None:
        """Keep a fitted model in a shared folder."""
        spark = _session()
        self.ml.write().overwrite().save(f"{path}/model")
        meta = {"kind": self.kind, "mode": self.mode, "columns": self.columns, "n_lags": self.n_lags, "exog": self.exog}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{path}/meta")
        if self.scale is not None:
            self.scale.write.mode("overwrite").parquet(f"{path}/scale")

    @staticmethod
    def load(path: str) -> "TreeModel":
        spark = _session()
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        cls = RandomForestRegressionModel if meta["kind"] == "forest" else GBTRegressionModel
        ml = cls.load(f"{path}/model")
        scale = spark.read.parquet(f"{path}/scale") if meta["mode"] != "features" else None
        return TreeModel(**meta, ml=ml, scale=scale, nodes=_read_nodes(spark, f"{path}/model", ml),
                         importances=_importances(ml, meta["columns"]))


def _session():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def _importances(ml, columns) -> dict[str, float]:
    return {c: float(v) for c, v in zip(columns, ml.featureImportances.toArray())}


def _read_nodes(spark, path: str, ml) -> NodeTable:
    """Node table of a saved ensemble (a model, so bounded by its parameters, not by the data)."""
    n = F.col("nodeData")
    pdf = spark.read.parquet(f"{path}/data").select(
        "treeID", n["id"].alias("id"), n["prediction"].alias("value"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        n["rawCount"].alias("cover")).toPandas()
    pdf = pdf.sort_values(["treeID", "id"], ignore_index=True)
    trees, first, size = np.unique(pdf["treeID"].to_numpy(), return_index=True, return_counts=True)
    shift = np.repeat(first, size)
    # ids of a tree run from 0 without gaps
    child = lambda c: np.where(pdf[c] >= 0, pdf[c] + shift, -1).astype(np.int32)
    forest = isinstance(ml, RandomForestRegressionModel)
    weight = np.full(len(trees), 1.0 / len(trees)) if forest else np.asarray(ml.treeWeights, float)
    return NodeTable(first.astype(np.int32), pdf["feature"].fillna(-1).to_numpy(np.int32), pdf["threshold"].fillna(0.0).to_numpy(float),
                     child("left"), child("right"), pdf["value"].to_numpy(float), pdf["cover"].to_numpy(float), weight)


def _estimator(kind: str, params: dict):
    if kind == "forest":
        q = {**FOREST_DEFAULTS, **params}
        return RandomForestRegressor(featuresCol="__x", labelCol="__label", numTrees=q["n_estimators"], maxDepth=q["max_depth"],
                                     featureSubsetStrategy="all", seed=SEED)
    q = {**BOOSTED_DEFAULTS, **params}
    return GBTRegressor(featuresCol="__x", labelCol="__label", maxIter=q["n_estimators"], stepSize=q["learning_rate"],
                        maxDepth=max(1, math.ceil(math.log2(q["num_leaves"]))), seed=SEED)


def _fit(kind, mode, rows: DataFrame, columns, n_lags, exog, scale, params) -> TreeModel:
    spark = rows.sparkSession
    data = VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="skip").transform(rows).select("__x", "__label")
    ml = _estimator(kind, params).fit(data)
    path = f"{scratch_dir(spark)}/trees-{uuid.uuid4().hex}"
    ml.write().overwrite().save(path)
    return TreeModel(kind, mode, columns, n_lags, list(exog), ml, scale, _read_nodes(spark, path, ml), _importances(ml, columns))


def target_scale(p: Panel, df: DataFrame | None = None) -> DataFrame:
    """Mean and std (ddof 0; 1 where zero) of the target per series."""
    got = p.aggregate(F.avg(p.y).alias("__m"), F.stddev_pop(p.y).alias("__s"), df=df)
    return got.select(*p.keys, "__m", F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0).alias("__s"))


def lag_table(p: Panel, n_lags: int, exog=(), scale: DataFrame | None = None) -> DataFrame:
    """Standardized lags beside the covariates of the same row."""
    scale = target_scale(p) if scale is None else scale
    rows = p.attach(p.df, scale)
    rows = rows.select(*p.keys, p.spec.time, *p.spec.tie, *exog, ((p.y - F.col("__m")) / F.col("__s")).alias("__label"))
    q = p.derive(rows, target="__label", features=())
    return lag_matrix(q, n_lags)


def fit_lag_trees(p: Panel, kind: str, n_lags: int = LAGS, exog=(), **params) -> TreeModel:
    """M5/M6 (lags) and M9/M10 (lags and covariates): one model over all series."""
    scale = stage(target_scale(p), "scale")
    columns = [f"lag_{k}" for k in range(1, n_lags + 1)] + list(exog)
    rows = lag_table(p, n_lags, exog, scale).select(*columns, "__label").dropna()
    return _fit(kind, "both" if exog else "lags", rows, columns, n_lags, exog, scale, params)


def fit_feature_trees(p: Panel, kind: str, **params) -> TreeModel:
    """M7/M8: target from the covariates of the same row."""
    columns = list(p.spec.features)
    rows = p.df.where(present(p.y)).select(*[F.col(c).cast("double").alias(c) for c in columns], p.y.cast("double").alias("__label")).dropna()
    return _fit(kind, "features", rows, columns, 0, (), None, params)


def predict_features(model: TreeModel, df: DataFrame, name: str = "yhat") -> DataFrame:
    """Score rows that hold the covariates (JVM only)."""
    a = VectorAssembler(inputCols=model.columns, outputCol="__x", handleInvalid="keep").transform(df)
    return model.ml.transform(a).withColumnRenamed("prediction", name).drop("__x")


def forecast_lag_trees(p: Panel, model: TreeModel, horizon: int, future: DataFrame | None = None) -> DataFrame:
    """Predict, append, drop the oldest lag.  Whole batches of series advance together;
    each carries only its last lags (and, with covariates, the ``future`` rows (keys, h, ...)).
    Series without enough history repeat their last value (``fallback``)."""
    base_keys = [k for k in p.keys if k in model.scale.columns]
    seeds = tail_arrays(p, model.n_lags)
    seeds = key_join(seeds, F.broadcast(model.scale) if p.n_series <= 20_000 else model.scale, base_keys)
    if model.exog:
        listed = future.where(F.col("h") <= horizon).groupBy(*p.keys).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("h", *[F.col(c).cast("double").alias(c) for c in model.exog]))),
            lambda r: F.array(*[r[c] for c in model.exog])).alias("exog"))
        seeds = p.attach(seeds, listed, cells=horizon * len(model.exog))
    nodes = send(seeds.sparkSession, model.nodes)
    n_lags, n_exog, keys = model.n_lags, len(model.exog), p.keys
    schema = T.StructType([*[seeds.schema[k] for k in keys], T.StructField("path", T.ArrayType(T.DoubleType()))])

    def run(batches):
        table = nodes()
        for b in batches:
            b = b[b["values"].map(len) == n_lags]
            if n_exog:
                b = b[b["exog"].map(len) == horizon]
            if not len(b):
                continue
            mean, std = b["__m"].to_numpy()[:, None], b["__s"].to_numpy()[:, None]
            lags = (np.stack(b["values"].to_numpy())[:, ::-1] - mean) / std  # lag_1 first
            exog = np.stack([np.stack(r) for r in b["exog"]]) if n_exog else None
            steps = []
            for h in range(horizon):
                x = np.hstack([lags, exog[:, h]]) if n_exog else lags
                v = table.predict(x)
                steps.append(v)
                lags = np.hstack([v[:, None], lags[:, :-1]])
            path = np.stack(steps, axis=1) * std + mean
            yield b[keys].reset_index(drop=True).assign(path=list(path))

    paths = seeds.mapInPandas(run, schema)
    out = p.attach(naive(p, horizon), paths, "left", cells=horizon)
    got = F.get("path", F.col("h") - 1)
    return out.select(*keys, "h", F.coalesce(got, F.col("yhat")).alias("yhat"), got.isNull().alias("fallback"))


def importance_table(spark, model: TreeModel, name: str = "") -> DataFrame:
    """Importance of each column as % of the absolute sum."""
    total = sum(abs(v) for v in model.importances.values()) or 1.0
    rows = [(name, c, round(abs(v) / total * 100, 1)) for c, v in model.importances.items()]
    return spark.createDataFrame(rows, "model string, feature string, importance_pct double")


# ---- Shapley values ------------------------------------------------------------------------

def leaf_groups(nodes: NodeTable, t: int, columns: int):
    """Leaves of one tree, grouped by the number m of features on their path: (features, low, high,
    cover fraction: leaves x m, value).  All nodes of a level go down together."""
    at, found = nodes.root[t:t + 1], []
    low, high = np.full((1, columns), -np.inf), np.full((1, columns), np.inf)
    share, used = np.ones((1, columns)), np.zeros((1, columns), bool)
    while len(at):
        leaf = nodes.left[at] < 0
        found.append((low[leaf], high[leaf], share[leaf], used[leaf], nodes.value[at[leaf]]))
        at, low, high, share, used = at[~leaf], low[~leaf], high[~leaf], share[~leaf], used[~leaf]
        n, f, cut = len(at), nodes.feature[at], nodes.threshold[at]
        child = np.concatenate([nodes.left[at], nodes.right[at]])
        low, high, share, used = (np.concatenate([a, a]) for a in (low, high, share, used))
        one, two, both = np.arange(n), np.arange(n, 2 * n), np.arange(2 * n)
        high[one, f] = np.minimum(high[one, f], cut)
        low[two, f] = np.maximum(low[two, f], cut)
        split = np.concatenate([f, f])
        share[both, split] *= nodes.cover[child] / nodes.cover[np.concatenate([at, at])]
        used[both, split] = True
        at = child
    low, high, share, used, value = (np.concatenate(a) for a in zip(*found))
    size = used.sum(axis=1)
    for m in np.unique(size):
        i = np.flatnonzero(size == m)
        feats = np.argsort(~used[i], axis=1, kind="stable")[:, :m]
        pick = lambda a: np.take_along_axis(a[i], feats, axis=1)
        yield feats, pick(low), pick(high), pick(share), value[i]


def path_shares(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Shapley values of product games: ``one`` (.. x m, the factor of a known feature) and ``zero`` (of an
    unknown one).  Player i gets (one - zero)[i] times the mean over s in 0..1 of the product of the
    other factors at (1 - s) zero + s one, a polynomial of degree m - 1 in s: Gauss points give it exactly."""
    m = zero.shape[-1]
    points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    out = np.zeros(np.broadcast_shapes(one.shape, zero.shape))
    for s, w in zip((points + 1) / 2, weights / 2):
        factor = (1 - s) * zero + s * one
        ahead, behind = np.ones_like(factor), np.ones_like(factor)
        np.cumprod(factor[..., :-1], axis=-1, out=ahead[..., 1:])
        behind[..., :-1] = np.cumprod(factor[..., :0:-1], axis=-1)[..., ::-1]
        out += w * ahead * behind
    return (one - zero) * out


def shapley(nodes: NodeTable, x: np.ndarray):
    """Path-dependent Shapley values (rows x columns) and the base value.

    A leaf's share for a feature is the Shapley value of a product game over the m features of
    its path: each is either known (inside its interval or not) or weighted by its cover.  What a
    leaf gives depends on which of the m intervals hold the row: where these 2^m cases are fewer
    than the rows, each is worked out once and looked up."""
    out, base = np.zeros(x.shape), 0.0
    for t in range(len(nodes.weight)):
        for feats, low, high, zero, value in leaf_groups(nodes, t, x.shape[1]):
            leaves, m = feats.shape
            value = value * nodes.weight[t]
            base += float(value @ zero.prod(axis=1))
            if not m or not len(x):
                continue
            size = max(1, CELLS // (m << min(m, 8)))
            for i in range(0, leaves, size):
                out += _group_shares(x, *(a[i:i + size] for a in (feats, low, high, zero, value)))
    return out, base


def _group_shares(x, feats, low, high, zero, value) -> np.ndarray:
    (leaves, m), out = feats.shape, np.zeros(x.shape)
    place = np.zeros((m, leaves, x.shape[1]))  # each leaf's share goes to its feature's column
    np.put_along_axis(place, feats.T[:, :, None], 1.0, axis=2)
    inside = lambda rows, j: (rows[:, feats[:, j]] > low[:, j]) & (rows[:, feats[:, j]] <= high[:, j])
    cases = 1 << m if m <= 8 else 0
    if 0 < cases < len(x):
        known = (np.arange(cases)[:, None] >> np.arange(m) & 1).astype(float)
        table = path_shares(known[None], zero[:, None]) * value[:, None, None]  # leaves x cases x m
        flat, start = np.ascontiguousarray(table.reshape(leaves * cases, m).T), np.arange(leaves) * cases
    done = 0
    for rows in pieces(x, leaves * m):
        if 0 < cases < len(x):
            at = start + sum(inside(rows, j).astype(np.int64) << j for j in range(m))
            shares = [flat[j][at] for j in range(m)]
        else:
            known = np.stack([inside(rows, j) for j in range(m)], axis=2).astype(float)
            shares = np.moveaxis(path_shares(known, zero[None]) * value[None, :, None], 2, 0)
        out[done:done + len(rows)] = sum(s @ place[j] for j, s in enumerate(shares))
        done += len(rows)
    return out


def shap_values(model: TreeModel, rows: DataFrame, keep=()) -> DataFrame:
    """E5: one row per input row and feature: (keep..., feature, shap, base)."""
    nodes = send(rows.sparkSession, model.nodes)
    columns = model.columns
    src = rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[src.schema[k] for k in keep], T.StructField("phi", arr), T.StructField("base", T.DoubleType())])

    def run(batches):
        table = nodes()
        for b in batches:
            if len(b):
                phi, base = shapley(table, b[columns].to_numpy(float))
                yield b[list(keep)].reset_index(drop=True).assign(phi=list(phi), base=base)

    got = src.mapInPandas(run, schema)
    names = F.array(*[F.lit(c) for c in columns])
    return got.select(*keep, "base", F.posexplode("phi").alias("pos", "shap")).select(
        *keep, F.get(names, F.col("pos")).alias("feature"), "shap", "base")


def shap_summary(p: Panel, model: TreeModel, last: int = 10) -> DataFrame:
    """E5: mean |Shapley value| over the last ``last`` rows of each series, as % of its sum."""
    if model.mode == "features":
        rows = p.tail(last)
    else:
        # the last rows with their lags need no more than that much history
        short = p.derive(p.tail(last + model.n_lags).drop("idx", "n"))
        rows = lag_table(short, model.n_lags, model.exog, model.scale)
    rows = rows.where(F.col("idx") >= F.col("n") - last).select(*p.keys, *model.columns).repartition(*(p.keys or [F.lit(0)]))
    v = shap_values(model, rows, p.keys).groupBy(*p.keys, "feature").agg(F.avg(F.abs("shap")).alias("mean_abs"))
    total = v.groupBy(*p.keys).agg(F.sum("mean_abs").alias("__t"))
    return p.attach(v, total).select(*p.keys, "feature", F.round(F.col("mean_abs") / F.when(F.col("__t") > 0, F.col("__t")).otherwise(1.0) * 100, 1).alias("shap_pct"))

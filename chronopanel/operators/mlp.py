"""Three-layer ReLU network on lags, trained by full-batch Adam as Spark jobs.

A full-batch gradient is a sum over rows: every epoch each task sums the gradients of its
Arrow batches (numpy), Spark adds the partial sums per parameter, and the driver holds only the
parameters and takes the Adam step."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..shared import key_join, stage
from .naive import naive
from .panel import Panel
from .smoothing import tail_arrays
from .trees import lag_table, target_scale

DEFAULTS = {"n_lags": 24, "hidden_size": 64, "epochs": 50, "learning_rate": 0.001}
SEED = 42


@dataclass
class Network:
    n_lags: int
    hidden: int
    theta: np.ndarray
    scale: DataFrame
    losses: list[float]


def _shapes(n_lags: int, hidden: int):
    return [(n_lags, hidden), (hidden,), (hidden, hidden), (hidden,), (hidden, 1), (1,)]


def _unpack(theta, n_lags, hidden):
    out, at = [], 0
    for s in _shapes(n_lags, hidden):
        size = int(np.prod(s))
        out.append(theta[at:at + size].reshape(s))
        at += size
    return out


def _start(n_lags: int, hidden: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    parts = []
    for s, fan in zip(_shapes(n_lags, hidden), (n_lags, n_lags, hidden, hidden, hidden, hidden)):
        bound = 1 / np.sqrt(fan)
        parts.append(rng.uniform(-bound, bound, s).ravel())
    return np.concatenate(parts)


def predict(theta, x, n_lags, hidden):
    w1, b1, w2, b2, w3, b3 = _unpack(theta, n_lags, hidden)
    a = np.maximum(x @ w1 + b1, 0)
    b = np.maximum(a @ w2 + b2, 0)
    return (b @ w3 + b3)[:, 0]


def _gradient(theta, x, y, n_lags, hidden):
    """Squared-error sum and its gradient."""
    w1, b1, w2, b2, w3, b3 = _unpack(theta, n_lags, hidden)
    a = np.maximum(x @ w1 + b1, 0)
    b = np.maximum(a @ w2 + b2, 0)
    err = (b @ w3 + b3)[:, 0] - y
    d3 = 2 * err[:, None]
    d2 = (d3 @ w3.T) * (b > 0)
    d1 = (d2 @ w2.T) * (a > 0)
    grads = [x.T @ d1, d1.sum(0), a.T @ d2, d2.sum(0), b.T @ d3, d3.sum(0)]
    return float(err @ err), np.concatenate([g.ravel() for g in grads])


def fit_mlp(p: Panel, n_lags: int = 24, hidden_size: int = 64, epochs: int = 50, learning_rate: float = 0.001) -> Network:
    """One network over all series (targets standardized per series)."""
    scale = stage(target_scale(p), "scale")
    lags = [f"lag_{k}" for k in range(1, n_lags + 1)]
    rows = stage(lag_table(p, n_lags, (), scale).select(F.array(*lags).alias("x"), F.col("__label").alias("y")), "mlp-rows")
    count = rows.count()
    theta = _start(n_lags, hidden_size)
    m, v, losses = np.zeros_like(theta), np.zeros_like(theta), []
    schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("g", T.DoubleType())])
    spark = rows.sparkSession
    for epoch in range(1, epochs + 1 if count else 1):
        sent = spark.sparkContext.broadcast(theta)

        def partial(batches):
            total = np.zeros(len(sent.value) + 1)
            for b in batches:
                if b.num_rows:
                    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n_lags)
                    loss, g = _gradient(sent.value, x, b.column("y").to_numpy(zero_copy_only=False), n_lags, hidden_size)
                    total[0] += loss
                    total[1:] += g
            yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(len(total)), pa.int32()), "g": pa.array(total)})

        summed = rows.mapInArrow(partial, schema).groupBy("pos").agg(F.sum("g").alias("g")).toPandas()
        full = np.zeros(len(theta) + 1)
        full[summed["pos"].to_numpy()] = summed["g"].to_numpy()
        losses.append(full[0] / count)
        g = full[1:] / count
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - learning_rate * (m / (1 - 0.9 ** epoch)) / (np.sqrt(v / (1 - 0.999 ** epoch)) + 1e-8)
        sent.unpersist()
    return Network(n_lags, hidden_size, theta, scale, losses)


def forecast_mlp(p: Panel, net: Network, horizon: int) -> DataFrame:
    """Recursive forecasts; series shorter than the lags repeat their last value."""
    base_keys = [k for k in p.keys if k in net.scale.columns]
    seeds = key_join(tail_arrays(p, net.n_lags), F.broadcast(net.scale) if p.n_series <= 20_000 else net.scale, base_keys)
    theta, n_lags, hidden, keys = net.theta, net.n_lags, net.hidden, p.keys
    schema = T.StructType([*[seeds.schema[k] for k in keys], T.StructField("path", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            b = b[b["values"].map(len) == n_lags]
            if not len(b):
                continue
            mean, std = b["__m"].to_numpy()[:, None], b["__s"].to_numpy()[:, None]
            lags = (np.stack(b["values"].to_numpy())[:, ::-1] - mean) / std
            steps = []
            for _ in range(horizon):
                v = predict(theta, lags, n_lags, hidden)
                steps.append(v)
                lags = np.hstack([v[:, None], lags[:, :-1]])
            yield b[keys].reset_index(drop=True).assign(path=list(np.stack(steps, axis=1) * std + mean))

    paths = seeds.mapInPandas(run, schema)
    out = p.attach(naive(p, horizon), paths, "left", cells=horizon)
    got = F.get("path", F.col("h") - 1)
    return out.select(*keys, "h", F.coalesce(got, F.col("yhat")).alias("yhat"), got.isNull().alias("fallback"))

"""Exponential smoothing with additive or multiplicative trend and season."""

from __future__ import annotations

import pickle
from collections import defaultdict
from itertools import product
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from ..shared import key_join, stage
from . import smoothing_scan
from .panel import Panel

LEVEL_GRID = (0.05, 0.2, 0.4, 0.6, 0.8, 0.95)
TREND_GRID = (0.01, 0.1, 0.3)
SEASON_GRID = (0.01, 0.1, 0.3, 0.6)
ZOOM = 0.08 * np.linspace(-1, 1, 5)
CELLS = 4_000_000  # values of series handled together


def tail_arrays(p: Panel, size: int | None) -> DataFrame:
    """One row per series: the last ``size`` target values in order (None: all)."""
    tail = p.indexed() if size is None else p.tail(size)
    values = F.transform(F.array_sort(F.collect_list(F.struct("idx", p.y.cast("double").alias("v")))), lambda r: r["v"])
    return tail.groupBy(*p.keys).agg(values.alias("values"), F.max("n").alias("n"))


def ets(p: Panel, horizon: int, trend: str = "add", seasonal: str = "add", seasonal_periods: int = 12,
        context: int | None = None, parameters: tuple[float, float, float] | None = None) -> DataFrame:
    """M4: Holt-Winters; smoothing parameters by least squares on a grid with one zoom round, or given
    as ``parameters`` (level, trend, season).

    The whole history is used (``context``: only its last rows).  The blocks of a long series are smoothed in
    parallel where the update is additive; multiplicative states are carried from block to block.

    Multiplicative parts become additive where the data are not strictly positive; a season
    longer than half the history falls back to simple smoothing (``fallback``)."""
    options = (trend, seasonal, seasonal_periods, parameters)
    if context is None and p.longest > p.spec.block_rows:
        got = _long(p, horizon, options)
    else:
        rows = tail_arrays(p, context)
        keys = p.keys
        schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("yhat", T.ArrayType(T.DoubleType())),
                               T.StructField("fallback", T.BooleanType())])

        def run(batches):
            for b in batches:
                fits = _fit([np.asarray(v, float) for v in b["values"]], horizon, options)
                out = b[keys].reset_index(drop=True)
                yield out.assign(yhat=[f.tolist() for f, _ in fits], fallback=[x for _, x in fits])

        got = rows.mapInPandas(run, schema)
    return got.select(*p.keys, "fallback", F.posexplode("yhat").alias("pos", "yhat")).select(
        *p.keys, (F.col("pos") + 1).alias("h"), "yhat", "fallback")


def _modes(n: int, low: float, options) -> tuple[str, str, bool]:
    trend, seasonal, sp, _ = options
    fallback = n < 4 or (seasonal != "none" and n < 2 * sp)
    if fallback:
        trend = seasonal = "none"
    if low <= 0:
        trend, seasonal = (x.replace("mul", "add") for x in (trend, seasonal))
    return trend, seasonal, fallback


def _grid(trend: str, seasonal: str, parameters) -> np.ndarray:
    if parameters is not None:
        return np.array([parameters], float)
    return np.array(list(product(LEVEL_GRID, TREND_GRID if trend != "none" else (0.0,), SEASON_GRID if seasonal != "none" else (0.0,))))


def _around(best: np.ndarray, trend: str, seasonal: str) -> np.ndarray:
    used = np.array([True, trend != "none", seasonal != "none"])
    steps = np.array(list(product(*[ZOOM if u else (0.0,) for u in used])))
    return np.where(used, np.clip(best + steps, 0.001, 0.999), 0.0)


def _begin(y: np.ndarray, params: np.ndarray, trend: str, seasonal: str, sp: int) -> dict:
    """State before the first value, for all parameter sets; ``y`` holds the first two seasons at least."""
    m = len(params)
    if seasonal != "none":
        first, second = y[:sp].mean(), y[sp:2 * sp].mean()
        season = np.tile(y[:sp] - first if seasonal == "add" else y[:sp] / first, (m, 1))
        slope = (second - first) / sp if trend != "mul" else (second / first) ** (1 / sp)
    else:
        first, season = y[0], np.zeros((m, 1))
        slope = (y[1] - y[0] if trend != "mul" else y[1] / y[0]) if len(y) > 1 else 0.0
    return {"params": params, "level": np.full(m, first), "slope": np.full(m, slope), "season": season, "sse": np.zeros(m), "t": 0}


def _advance(values: list[np.ndarray], states: list[dict], trend: str, seasonal: str, sp: int) -> list[dict]:
    """Carry the states of series of one kind over their next values: one pass over time for all series
    and all parameter sets."""
    by = sorted(range(len(values)), key=lambda i: -len(values[i]))
    lengths = np.array([len(values[i]) for i in by])
    pick = lambda name: np.stack([states[i][name] for i in by])
    a, b, g = np.moveaxis(pick("params"), 2, 0)
    level, slope, season, sse = (pick(x).astype(float) for x in ("level", "slope", "season", "sse"))
    start = np.array([states[i]["t"] for i in by])
    padded = np.zeros((int(lengths.max(initial=0)), len(by)))
    for j, i in enumerate(by):
        padded[:lengths[j], j] = values[i]
    with np.errstate(all="ignore"):
        for t, row in enumerate(padded):
            k = int(np.searchsorted(-lengths, -t, "left"))  # series that still have a value
            v, w = row[:k, None], slice(0, k)
            base = level[w] + slope[w] if trend == "add" else level[w] * slope[w] if trend == "mul" else level[w]
            if seasonal != "none":
                at = (np.arange(k), slice(None), (start[:k] + t) % sp)
                s = season[at]
                fit, seen = (base + s, v - s) if seasonal == "add" else (base * s, v / s)
            else:
                fit, seen = base, v
            sse[w] += (v - fit) ** 2
            new = a[w] * seen + (1 - a[w]) * base
            if trend == "add":
                slope[w] = b[w] * (new - level[w]) + (1 - b[w]) * slope[w]
            elif trend == "mul":
                slope[w] = b[w] * (new / level[w]) + (1 - b[w]) * slope[w]
            if seasonal != "none":
                season[at] = g[w] * (v - base if seasonal == "add" else v / base) + (1 - g[w]) * s
            level[w] = new
    out = [None] * len(by)
    for j, i in enumerate(by):
        out[i] = {"params": states[i]["params"], "level": level[j], "slope": slope[j], "season": season[j], "sse": sse[j], "t": int(start[j] + lengths[j])}
    return out


def _least(state: dict) -> dict:
    """The parameter set of least squared error."""
    k = int(np.nanargmin(np.where(np.isfinite(state["sse"]), state["sse"], np.inf)))
    return {"t": state["t"], **{x: state[x][k] for x in ("params", "level", "slope", "season", "sse")}}


def _path(s: dict, trend: str, seasonal: str, sp: int, horizon: int, last: float, fallback: bool):
    h = np.arange(1, horizon + 1)
    with np.errstate(all="ignore"):
        path = s["level"] + h * s["slope"] if trend == "add" else s["level"] * s["slope"] ** h if trend == "mul" else np.full(horizon, s["level"])
        if seasonal != "none":
            phase = s["season"][(s["t"] + h - 1) % sp]
            path = path + phase if seasonal == "add" else path * phase
    ok = np.all(np.isfinite(path))
    return (path if ok else np.full(horizon, last)), bool(fallback or not ok)


def _fit(series: list[np.ndarray], horizon: int, options) -> list[tuple[np.ndarray, bool]]:
    """Forecast of each series held in memory."""
    sp, out, kinds = options[2], [None] * len(series), defaultdict(list)
    clean = [y[~np.isnan(y)] for y in series]
    for i, y in enumerate(clean):
        if len(y):
            kinds[_modes(len(y), y.min(), options)].append(i)
        else:
            out[i] = np.full(horizon, np.nan), True
    for (trend, seasonal, fallback), members in kinds.items():
        width = max(1, CELLS // max(len(clean[i]) for i in members))
        for a in range(0, len(members), width):
            part = members[a:a + width]
            ys = [clean[i] for i in part]
            best = [_least(s) for s in _advance(ys, [_begin(y, _grid(trend, seasonal, options[3]), trend, seasonal, sp) for y in ys], trend, seasonal, sp)]
            if options[3] is None:
                near = [_least(s) for s in _advance(ys, [_begin(y, _around(s["params"], trend, seasonal), trend, seasonal, sp) for y, s in zip(ys, best)], trend, seasonal, sp)]
                best = [n if n["sse"] <= s["sse"] else s for s, n in zip(best, near)]
            for i, s in zip(part, best):
                out[i] = _path(s, trend, seasonal, sp, horizon, clean[i][-1], fallback)
    return out


def _long(p: Panel, horizon: int, options) -> DataFrame:
    """The same for series longer than a block: additive updates of all blocks at once (``smoothing_scan``),
    multiplicative ones, whose update is not affine, block after block."""
    sp, keys, y = options[2], p.keys, p.y.cast("double")
    present = p.derive(p.df.select(*keys, p.spec.time, *p.spec.tie, y.alias("__y")).where("__y IS NOT NULL AND NOT isnan(__y)"), target="__y", features=())
    rows, _ = present.blocked()
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("idx", "__y")))), lambda r: r["__y"])
    blocks = rows.where("__core").groupBy(*keys, "__block").agg(ordered(F.lit(True)).alias("values"), F.min("idx").alias("t"))
    facts = rows.where("__core").groupBy(*keys).agg(F.max("n").alias("n"), F.min("__y").alias("low"), ordered(F.col("idx") < max(2 * sp, 2)).alias("head"),
                                                    F.max_by("__y", "idx").alias("last"), (F.max("__block") + 1).alias("blocks"))
    facts = stage(facts, "ets-facts")
    # as in _modes: a series is smoothed multiplicatively only if it is long enough and positive
    curved = F.lit("mul" in options[:2]) & (F.col("low") > 0) & (F.col("n") >= (max(4, 2 * sp) if options[1] != "none" else 4))
    some = stage(facts.groupBy(curved.alias("curved")).count(), "ets-kinds")
    kinds = {r["curved"] for r in some.collect()}
    best = None
    if False in kinds:
        flat = facts.where(~curved)
        here = stage(key_join(blocks, flat.select(*keys), keys), "ets-blocks") if True in kinds else stage(blocks, "ets-blocks")
        best = smoothing_scan.fit(keys, here, flat, options, _TOOLS)
    if True in kinds:
        bent = facts.where(curved)
        found = _folded(p, stage(key_join(blocks, bent.select(*keys), keys), "ets-blocks", by="__block"), bent, options)
        best = found if best is None else best.union(found)

    def paths(batches):
        for b in batches:
            made = []
            for _, r in b.iterrows():
                trend, seasonal, fallback = _modes(r["n"], r["low"], options)
                made.append(_path(pickle.loads(r["best"]), trend, seasonal, sp, horizon, r["last"], fallback))
            yield b[keys].assign(yhat=[f.tolist() for f, _ in made], fallback=[x for _, x in made])

    result = T.StructType([*[facts.schema[k] for k in keys], T.StructField("yhat", T.ArrayType(T.DoubleType())), T.StructField("fallback", T.BooleanType())])
    if best is None:
        return facts.select(*keys, F.array().cast("array<double>").alias("yhat"), F.lit(True).alias("fallback"))
    return key_join(facts, best, keys).mapInPandas(paths, result)


def _folded(p: Panel, blocks: DataFrame, facts: DataFrame, options) -> DataFrame:
    """(keys, best) by a fold from block to block: one staged state per series, a job per block that reads its
    block only."""
    sp, keys = options[2], p.keys
    schema = T.StructType([*[facts.schema[k] for k in keys], T.StructField("state", T.BinaryType())])
    order = [r[0] for r in blocks.select("__block").distinct().orderBy("__block").collect()]  # at most longest / block_rows

    def start(best: bool):
        def run(batches):
            for b in batches:
                made = []
                for _, r in b.iterrows():
                    trend, seasonal, _ = _modes(r["n"], r["low"], options)
                    params = _around(pickle.loads(r["best"])["params"], trend, seasonal) if best else _grid(trend, seasonal, options[3])
                    made.append(pickle.dumps(_begin(np.asarray(r["head"], float), params, trend, seasonal, sp)))
                yield b[keys].assign(state=made)
        return run

    def carry(batches):
        for b in batches:
            made = []
            for _, r in b.iterrows():
                state = pickle.loads(r["state"])
                if r["values"] is not None:
                    trend, seasonal, _ = _modes(r["n"], r["low"], options)
                    state = _advance([np.asarray(r["values"], float)], [state], trend, seasonal, sp)[0]
                made.append(pickle.dumps(state))
            yield b[keys].assign(state=made)

    def choose(batches):
        for b in batches:
            made = []
            for _, r in b.iterrows():
                new, old = _least(pickle.loads(r["state"])), None if r["best"] is None else pickle.loads(r["best"])
                made.append(pickle.dumps(new if old is None or new["sse"] <= old["sse"] else old))
            yield b[keys].assign(state=made)

    best = facts.select(*keys, F.lit(None).cast("binary").alias("best"))
    for zoom in (False, True) if options[3] is None else (False,):
        state = stage(key_join(facts, best, keys).mapInPandas(start(zoom), schema), "ets-state")
        for block in order:
            here = blocks.where(F.col("__block") == block).select(*keys, "values")
            state = stage(key_join(key_join(state, facts.select(*keys, "n", "low"), keys), here, keys, "left").mapInPandas(carry, schema), "ets-state")
        best = stage(key_join(state, best, keys).mapInPandas(choose, schema), "ets-best").withColumnRenamed("state", "best")
    return best


_TOOLS = SimpleNamespace(modes=_modes, grid=_grid, around=_around, begin=_begin, advance=_advance, least=_least)

"""Additive exponential smoothing of long series, all blocks in parallel.

With fixed parameters one step of the additive update is an affine map of the state (level, slope, season). In
coordinates where the season that comes next stands first, its matrix M is the same at every step, so a block of n
values is the map x -> M^n x + c, and c is where the block ends when it starts from zero. Two passes over the
values do the work of one fold, whatever the number of blocks:

1. every block is folded from zero at once, which gives its c for every parameter set;
2. the maps are composed along each series (an associative scan: groups of blocks are composed first, and their
   maps along the series, level by level), which gives the state each block starts from;
3. every block is folded again from its true state, which gives its squared errors.

The matrices are never moved: M^n follows from the parameters and n by repeated squaring.
"""

from __future__ import annotations

import pickle
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..shared import key_join, stage

#: blocks composed by one task
FAN = 256
#: numbers in the matrix powers, and in the states, handled together
CELLS = 4_000_000


def step_matrix(params: np.ndarray, trend: str, seasonal: str, sp: int) -> np.ndarray:
    """M of each parameter set (level, trend, season), for the state (level, slope, season of the next step, ...)."""
    a, b, g = params.T
    size = 2 + (sp if seasonal != "none" else 0)
    base = np.zeros((len(params), size))
    base[:, 0] = 1
    base[:, 1] = trend == "add"
    m = np.zeros((len(params), size, size))
    m[:, 0] = (1 - a)[:, None] * base
    if seasonal != "none":
        m[:, 0, 2] -= a
        m[:, 2 + np.arange(sp - 1), 3 + np.arange(sp - 1)] = 1
        m[:, 1 + sp] = -g[:, None] * base
        m[:, 1 + sp, 2] += 1 - g
    m[:, 1, 1] = 1
    if trend == "add":
        m[:, 1] = b[:, None] * m[:, 0]
        m[:, 1, 0] -= b
        m[:, 1, 1] += 1 - b
    return m


def along(lengths: list[int], ends: list[np.ndarray], x: np.ndarray, matrix: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The state before each of consecutive blocks, and after the last; ``x`` is the state before the first."""
    starts = [np.empty_like(x) for _ in lengths]
    last = np.empty_like(x)
    bits = max([n.bit_length() for n in lengths], default=0)
    width = max(1, CELLS // (max(bits, 1) * matrix.shape[1] ** 2))
    with np.errstate(all="ignore"):
        for i in range(0, len(x), width):
            part = slice(i, i + width)
            powers = [matrix[part]]
            while len(powers) < bits:
                powers.append(powers[-1] @ powers[-1])
            now = x[part]
            for n, c, before in zip(lengths, ends, starts):
                before[part] = now
                for j in range(n.bit_length()):
                    if n >> j & 1:
                        now = (powers[j] @ now[:, :, None])[:, :, 0]
                now = now + c[part]
            last[part] = now
    return starts, last


def flat(state: dict, seasonal: str, sp: int) -> np.ndarray:
    """A state of the fold as vectors, one for each parameter set."""
    x = np.stack([state["level"], state["slope"]], axis=1)
    return np.hstack([x, state["season"][:, (state["t"] + np.arange(sp)) % sp]]) if seasonal != "none" else x


def unflat(x: np.ndarray, t: int, params: np.ndarray, seasonal: str, sp: int) -> dict:
    season = np.zeros((len(x), 1))
    if seasonal != "none":
        season = np.empty((len(x), sp))
        season[:, (t + np.arange(sp)) % sp] = x[:, 2:]
    return {"params": params, "level": x[:, 0].copy(), "slope": x[:, 1].copy(), "season": season, "sse": np.zeros(len(x)), "t": t}


def fit(keys: list[str], blocks: DataFrame, facts: DataFrame, options: tuple, tools) -> DataFrame:
    """(keys, best): the pickled state of the best parameter set after the last value of each series.

    ``blocks`` (keys, __block, t, values) and ``facts`` (keys, n, low, head, last, spread) are staged; ``tools`` has
    the functions of the fold: modes, grid, around, begin, advance, least."""
    sp = options[2]
    key_fields = [facts.schema[k] for k in keys]
    binary, long = T.BinaryType(), T.LongType()
    shape = lambda *more: T.StructType([*key_fields, *[T.StructField(n, t) for n, t in more]])
    by = lambda df, *more: df.withColumn("__one", F.lit(0)).groupBy("__one", *keys, *more)
    most = facts.agg(F.max("blocks")).first()[0] or 0
    best = facts.select(*keys, F.lit(None).cast("binary").alias("best"))

    def plans(batches):
        """Parameter sets of each series and its state before the first value."""
        for b in batches:
            made = []
            for r in b.itertuples():
                trend, seasonal, _ = tools.modes(r.n, r.low, options)
                params = tools.grid(trend, seasonal, options[3]) if r.best is None else tools.around(pickle.loads(r.best)["params"], trend, seasonal)
                state = tools.begin(np.asarray(r.head, float), params, trend, seasonal, sp)
                made.append(pickle.dumps((trend, seasonal, params, flat(state, seasonal, sp))))
            yield b[keys].assign(plan=made)

    def folded(b: pd.DataFrame, known: bool):
        """The rows of a batch folded together where modes agree: (row, end state)."""
        kinds = defaultdict(list)
        plan = [pickle.loads(x) for x in b["plan"]]
        for i, (trend, seasonal, params, _) in enumerate(plan):
            kinds[trend, seasonal, len(params)].append(i)
        for (trend, seasonal, n), rows in kinds.items():
            step = max(1, CELLS // (n * (sp + 4)))
            for i in range(0, len(rows), step):
                some = rows[i:i + step]
                states = []
                for j in some:
                    x = pickle.loads(b["x"].iloc[j]) if known else np.zeros_like(plan[j][3])
                    states.append(unflat(x, int(b["t"].iloc[j]), plan[j][2], seasonal, sp))
                values = [np.asarray(b["values"].iloc[j], float) for j in some]
                yield from zip(some, tools.advance(values, states, trend, seasonal, sp), [seasonal] * len(some))

    def from_zero(batches):
        for b in batches:
            made = [None] * len(b)
            for j, state, seasonal in folded(b, False):
                made[j] = pickle.dumps(flat(state, seasonal, sp))
            yield b[[*keys, "__block", "steps", "plan"]].assign(c=made)

    def errors(batches):
        for b in batches:
            made = [None] * len(b)
            for j, state, _ in folded(b, True):
                made[j] = state["sse"].tolist()
            yield b[keys].assign(sse=made)

    def ordered(g: pd.DataFrame):
        g = g.sort_values("__block")
        trend, seasonal, params, first = pickle.loads(g["plan"].iloc[0])
        return g, [int(n) for n in g["steps"]], [pickle.loads(c) for c in g["c"]], step_matrix(params, trend, seasonal, sp), first

    def composed(g: pd.DataFrame) -> pd.DataFrame:
        g, lengths, ends, matrix, first = ordered(g)
        _, last = along(lengths, ends, np.zeros_like(first), matrix)
        return g[[*keys, "__up", "plan"]].iloc[:1].assign(steps=sum(lengths), c=[pickle.dumps(last)])

    def spread(g: pd.DataFrame) -> pd.DataFrame:
        """The state before each block; from the top group also that after the last, under block -1."""
        top = "x" not in g
        g, lengths, ends, matrix, first = ordered(g)
        starts, last = along(lengths, ends, first if top else pickle.loads(g["x"].iloc[0]), matrix)
        out = g[[*keys, "__block"]].assign(x=[pickle.dumps(s) for s in starts])
        if top:
            out = pd.concat([out, out.iloc[:1].assign(__block=-1, x=[pickle.dumps(last)])])
        return out

    def scan(maps: DataFrame, most: int) -> DataFrame:
        """(keys, __block, x) of ``maps`` (keys, __block, steps, plan, c), at most ``most`` of them in a series."""
        out = shape(("__block", long), ("x", binary))
        if most <= FAN:
            return by(maps).applyInPandas(lambda g: spread(g.drop(columns="__one")), out)
        # block numbers ascend with time and may have gaps: they are renumbered by group
        maps = maps.withColumn("__up", F.expr(f"__block div {FAN}"))
        ups = by(maps, "__up").applyInPandas(lambda g: composed(g), shape(("__up", long), ("plan", binary), ("steps", long), ("c", binary)))
        ups = stage(ups.withColumnRenamed("__up", "__block"), "ets-maps")
        above = stage(scan(ups, -(-most // FAN)), "ets-starts").withColumnRenamed("__block", "__up")
        within = by(key_join(maps, above.where("__up >= 0"), [*keys, "__up"]), "__up").applyInPandas(lambda g: spread(g.drop(columns="__one")), out)
        return within.union(above.where("__up = -1").select(*keys, F.col("__up").alias("__block"), "x"))

    def choose(batches):
        for b in batches:
            made = []
            for r in b.itertuples():
                trend, seasonal, params, _ = pickle.loads(r.plan)
                state = unflat(pickle.loads(r.x), int(r.n), params, seasonal, sp)
                state["sse"] = np.asarray(r.sse, float)
                new, old = tools.least(state), None if r.best is None else pickle.loads(r.best)
                made.append(pickle.dumps(new if old is None or new["sse"] <= old["sse"] else old))
            yield b[keys].assign(state=made)

    for _ in range(2 if options[3] is None else 1):
        plan = stage(key_join(facts.select(*keys, "n", "low", "head"), best, keys).mapInPandas(plans, shape(("plan", binary))), "ets-plan")
        with_plan = key_join(blocks.withColumn("steps", F.size("values").cast("long")), plan, keys)
        maps = with_plan.mapInPandas(from_zero, shape(("__block", long), ("steps", long), ("plan", binary), ("c", binary)))
        states = stage(scan(stage(maps, "ets-maps"), most), "ets-starts")
        sse = key_join(with_plan, states, [*keys, "__block"]).mapInPandas(errors, shape(("sse", T.ArrayType(T.DoubleType()))))
        sse = sse.select(*keys, F.posexplode("sse").alias("i", "e")).groupBy(*keys, "i").agg(F.sum("e").alias("e"))
        sse = sse.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda r: r["e"]).alias("sse"))
        last = states.where("__block = -1").select(*keys, "x")
        ready = key_join(key_join(key_join(key_join(plan, last, keys), sse, keys), best, keys), facts.select(*keys, "n"), keys)
        best = stage(ready.mapInPandas(choose, shape(("state", binary))), "ets-best").withColumnRenamed("state", "best")
    return best

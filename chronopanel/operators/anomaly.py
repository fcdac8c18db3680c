"""Anomaly detectors and their vote.

A detector takes ``(panel, df)``, where ``df`` holds the panel's rows, and returns ``df`` with
``score_<name>`` and ``flag_<name>``.  All thresholds are strict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import present
from ..shared import key_join, stage
from ..spec import SeriesSpec
from .panel import Panel
from .profile import quartile_bounds
from .quantiles import interpolate, order_statistics

MAX_CHANNELS = 10


def _mark(df: DataFrame, name: str, score, flag, *drop: str) -> DataFrame:
    return df.select("*", score.alias(f"score_{name}"), flag.alias(f"flag_{name}")).drop(*drop)


def _zscore_mark(y, threshold: float = 3.0):
    score = F.when(F.col("__std") == 0, 0.0).otherwise(F.abs((y - F.col("__mean")) / F.col("__std")))
    return score, score > threshold


def _mad_mark(y):
    score = F.when(F.col("__mad") == 0, 0.0).otherwise(0.6745 * F.abs(y - F.col("__med")) / F.col("__mad"))
    return score, score > F.col("__thr")


def _iqr_mark(y):
    beyond = F.greatest(F.col("__lo") - y, y - F.col("__hi"), F.lit(0.0))
    score = F.when(F.col("__iqr") == 0, 0.0).otherwise(beyond / F.col("__iqr"))
    return score, (y < F.col("__lo")) | (y > F.col("__hi"))


def zscore(p: Panel, df: DataFrame, threshold: float = 3.0) -> DataFrame:
    """A1: |y - mean| / std (ddof 0)."""
    stats = p.aggregate(F.avg(p.y).alias("__mean"), F.stddev_pop(p.y).alias("__std"))
    return _mark(p.attach(df, stats), "zscore", *_zscore_mark(p.y, threshold), "__mean", "__std")


def mad_statistics(p: Panel, threshold: float = 3.5, max_share: float = 0.05) -> DataFrame:
    """Median, mad and the threshold in force, one row per series."""
    med = order_statistics(p, p.spec.target, {"m": 0.5}).select(*p.keys, interpolate("m").alias("median"))
    dev = p.attach(p.df.select(*p.keys, p.y.alias("__y")), med).select(*p.keys, F.abs(F.col("__y") - F.col("median")).alias("__dev"))
    score = lambda d: F.when(F.col("mad") == 0, 0.0).otherwise(0.6745 * d / F.col("mad"))
    st = order_statistics(p, "__dev", {"a": 0.5, "t": 1 - max_share}, dev)
    st = st.select(*p.keys, interpolate("a").alias("mad"), "t_lo", "t_hi", "t_w")
    tail = interpolate("t", score(F.col("t_lo")), score(F.col("t_hi")))
    st = st.select(*p.keys, "mad", tail.alias("__tail"))
    share = p.attach(dev, st).groupBy(*p.keys).agg(
        F.avg((score(F.col("__dev")) > threshold).cast("double")).alias("__share"),
        F.min("mad").alias("mad"), F.min("__tail").alias("__tail"))
    limit = F.when(F.col("__share") > max_share, F.greatest(F.lit(threshold), F.col("__tail"))).otherwise(F.lit(threshold))
    return p.attach(share, med).select(*p.keys, "median", "mad", limit.alias("threshold"),
                                       (F.col("__share") > max_share).alias("adaptive"))


def mad(p: Panel, df: DataFrame, threshold: float = 3.5) -> DataFrame:
    """A2: 0.6745 |y - median| / mad; where more than 5 % are flagged, the threshold rises to
    the 95th percentile of the scores."""
    st = mad_statistics(p, threshold).select(*p.keys, F.col("median").alias("__med"), F.col("mad").alias("__mad"), F.col("threshold").alias("__thr"))
    return _mark(p.attach(df, st), "mad", *_mad_mark(p.y), "__med", "__mad", "__thr")


def rolling(p: Panel, df: DataFrame, window: int = 24, sigma_k: float = 3.0) -> DataFrame:
    """A3: |y - rolling mean| / (k * rolling std) > 1, trailing window."""
    y = p.y.cast("double")
    frame = lambda w: w.rowsBetween(-(window - 1), 0)
    # the running sum of a frame can leave a tiny remainder where all values are equal
    spread = lambda w: F.when(F.max(y).over(frame(w)) > F.min(y).over(frame(w)), F.stddev_samp(y).over(frame(w)))
    have = [c for c in ("idx", "n") if c in df.columns]
    d = p.over(lambda w: {"__rm": F.avg(y).over(frame(w)), "__rs": spread(w)}, before=window - 1, df=df.drop(*have))
    limit = sigma_k * F.col("__rs")
    score = F.when(limit > 0, F.abs(y - F.col("__rm")) / limit).otherwise(0.0)
    return _mark(d, "rolling", score, score > 1.0, "__rm", "__rs")


def iqr(p: Panel, df: DataFrame, k: float = 1.5) -> DataFrame:
    """A4: outside q1 - k iqr / q3 + k iqr; score = distance beyond the bound in iqr units."""
    b = quartile_bounds(p, k).select(*p.keys, F.col("iqr").alias("__iqr"), F.col("lower_bound").alias("__lo"), F.col("upper_bound").alias("__hi"))
    return _mark(p.attach(df, b), "iqr", *_iqr_mark(p.y), "__iqr", "__lo", "__hi")


def residual(p: Panel, df: DataFrame, period: int = 24, sigma: float = 3.0, method: str = "stl") -> DataFrame:
    """A5: |resid| / std(resid, ddof 0) of a seasonal decomposition; series shorter than two
    periods are never flagged."""
    from .decompose import classical, stl
    have = [c for c in ("idx", "n") if c in df.columns]
    q = p.derive(df.drop(*have))
    # the decomposition feeds both its residual std and the rows: run once
    d = classical(q, period) if method == "classical" else stage(stl(q, period), "residual")
    std = d.groupBy(*p.keys).agg(F.stddev_pop("resid").alias("__std"))
    ok = (F.col("n") >= 2 * period) & (F.col("__std") > 0) & F.col("resid").isNotNull()
    score = F.when(ok, F.abs("resid") / F.col("__std")).otherwise(0.0)
    return _mark(p.attach(d, std), "stl", score, score > sigma, "__std", "trend", "seasonal", "resid")


def isolation(p: Panel, df: DataFrame, **params) -> DataFrame:
    from .isolation_forest import isolation_forest
    return isolation_forest(p, df, **params)


def density(p: Panel, df: DataFrame, **params) -> DataFrame:
    from .density import dbscan
    return dbscan(p, df, **params)


#: Y2: name -> detector; the vote runs them in this order
DETECTORS = {"zscore": zscore, "mad": mad, "rolling": rolling, "iqr": iqr, "stl": residual,
             "iforest": isolation, "dbscan": density}
PER_CHANNEL = ("zscore", "mad", "rolling", "iqr", "stl")


def register_detector(name: str, detector) -> None:
    DETECTORS[name] = detector


#: detectors that need nothing but numbers of the whole series
FUSED = ("zscore", "mad", "iqr")


def series_statistics(p: Panel, threshold: float = 3.5, max_share: float = 0.05, k: float = 1.5) -> DataFrame:
    """What the detectors of ``FUSED`` need, one row per series, from one aggregate over the rows: the sorted
    values of a series (at most a block of them) give every quantile, also those of the deviations."""
    n = F.col("__n")
    def at(values, q: float):
        low = F.floor((n - 1) * F.lit(q)).cast("int")
        lo, hi = F.get(values, low), F.get(values, F.least(low + 1, n - 1).cast("int"))
        return lo, hi, (n - 1) * F.lit(q) - low
    mid = lambda values, q: (lambda lo, hi, w: lo + (hi - lo) * w)(*at(values, q))
    st = p.aggregate(F.avg(p.y).alias("__mean"), F.stddev_pop(p.y).alias("__std"), F.count(p.y).alias("__n"),
                     F.array_sort(F.collect_list(p.y.cast("double"))).alias("__s"))
    st = st.select(*p.keys, "__mean", "__std", "__n", "__s", mid("__s", 0.25).alias("__q1"), mid("__s", 0.5).alias("__med"), mid("__s", 0.75).alias("__q3"))
    st = st.withColumn("__dev", F.array_sort(F.transform("__s", lambda v: F.abs(v - F.col("__med"))))).withColumn("__mad", mid("__dev", 0.5))
    score = lambda d: F.when(F.col("__mad") == 0, 0.0).otherwise(0.6745 * d / F.col("__mad"))
    lo, hi, w = at("__dev", 1 - max_share)
    share = F.size(F.filter("__dev", lambda d: score(d) > threshold)) / n
    tail = score(lo) + (score(hi) - score(lo)) * w
    limit = F.when(share > max_share, F.greatest(F.lit(threshold), tail)).otherwise(F.lit(threshold))
    iqr_ = F.col("__q3") - F.col("__q1")
    return st.select(*p.keys, "__mean", "__std", "__med", "__mad", limit.alias("__thr"), iqr_.alias("__iqr"),
                     (F.col("__q1") - k * iqr_).alias("__lo"), (F.col("__q3") + k * iqr_).alias("__hi"))


def detect(p: Panel, methods=None, params: dict | None = None, df: DataFrame | None = None) -> DataFrame:
    """Rows with the scores and flags of the chosen detectors (target only)."""
    df = p.df if df is None else df
    methods, own = list(methods or DETECTORS), {"zscore": zscore, "mad": mad, "iqr": iqr}
    # two or more of these share one aggregate, where a series is short enough and nothing is set otherwise
    shared = [m for m in methods if m in FUSED and DETECTORS[m] is own[m] and not (params or {}).get(m)] if p.longest <= p.spec.block_rows else []
    shared = shared if len(shared) > 1 else []
    # ordered detectors first: their shuffle then carries no extra columns
    for name in sorted(methods, key=lambda m: m not in ("rolling", "stl")):
        if name not in shared:
            df = DETECTORS[name](p, df, **(params or {}).get(name, {}))
    if shared:
        df = p.attach(df, series_statistics(p))
        y, marks = p.y, {"zscore": _zscore_mark, "mad": _mad_mark, "iqr": _iqr_mark}
        for name in shared:
            df = _mark(df, name, *marks[name](y))
        df = df.drop("__mean", "__std", "__med", "__mad", "__thr", "__iqr", "__lo", "__hi")
    return df


def channels(p: Panel, limit: int | None = MAX_CHANNELS) -> DataFrame:
    """K2: the target and the ``limit - 1`` features (None: all) of largest variance (ddof 0), per
    series: (keys, channel, variance)."""
    feats = list(p.spec.features)
    v = p.aggregate(*[F.var_pop(F.col(c).cast("double")).alias(f"__{i}") for i, c in enumerate(feats)])
    long = v.select(*p.keys, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"__{i}").alias("variance"))
                                                 for i, c in enumerate(feats)])).alias("__i")).select(*p.keys, "__i.*")
    w = Window.partitionBy(*p.keys).orderBy(F.col("variance").desc_nulls_last(), "channel")
    ranked = long.withColumn("rank_no", F.row_number().over(w).cast("long"))
    return ranked if limit is None else ranked.where(F.col("rank_no") <= limit - 1)


def channel_flags(p: Panel, methods, params: dict | None = None, limit: int | None = MAX_CHANNELS) -> DataFrame:
    """Run per-channel detectors on target and features, OR the flags per row.
    ``p.df`` must hold ``idx``; returns (keys, idx, flag_*)."""
    cols = [p.spec.target, *p.spec.features]
    long = p.df.select(*p.keys, "idx", F.explode(F.array(*[F.struct(F.lit(c).alias("__channel"), F.col(c).cast("double").alias("__value"))
                                                          for c in cols])).alias("__i")).select(*p.keys, "idx", "__i.*")
    if limit is not None and len(p.spec.features) > limit - 1:
        keep = channels(p, limit).select(*p.keys, F.col("channel").alias("__channel"))
        own = p.aggregate(F.lit(p.spec.target).alias("__channel"))
        long = key_join(long, keep.unionByName(own), [*p.keys, "__channel"])
    long = long.withColumnRenamed("idx", "pos")
    # channels multiply the number of series, never the rows of one series
    spec = SeriesSpec(time="pos", target="__value", keys=(*p.spec.keys, "__channel"), block_rows=p.spec.block_rows)
    q = Panel(long, spec, (p.n_series * min(len(cols), limit or len(cols)), p.longest))
    flagged = detect(q, methods, params)
    return flagged.groupBy(*p.keys, F.col("pos").alias("idx")).agg(*[F.bool_or(f"flag_{m}").alias(f"flag_{m}") for m in methods])


def vote(p: Panel, methods=None, min_votes: int = 3, params: dict | None = None) -> DataFrame:
    """All detectors, ``votes`` and ``is_anomaly`` per row.

    With features, rows with any missing value are left out, channel detectors run on every
    channel and the matrix detectors on all columns together."""
    from .prep import complete_cases, drop_missing_target
    methods = list(methods or DETECTORS)
    if not p.spec.features:
        q = drop_missing_target(p)
        out = detect(q, methods, params)
    else:
        q = complete_cases(p)
        # read by every detector below; each row keeps its number
        rows = stage(q.indexed(), "channels")
        inner = q.derive(rows)
        single = [m for m in methods if m in PER_CHANNEL]
        joint = [m for m in methods if m not in PER_CHANNEL]
        out = rows
        for m in joint:
            out = DETECTORS[m](inner, out, **(params or {}).get(m, {}))
        if single:
            out = key_join(out, channel_flags(inner, single, params), [*p.keys, "idx"])
    votes = reduce(lambda a, b: a + b, [F.col(f"flag_{m}").cast("int") for m in methods]).cast("long")
    return out.withColumn("votes", votes).withColumn("is_anomaly", F.col("votes") >= min_votes)


def detection_summary(voted: DataFrame, keys, methods, min_votes: int = 3) -> DataFrame:
    """A10: counts per method, agreement, share flagged, warnings; one row per series."""
    hit = F.col("is_anomaly")
    got = voted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(hit.cast("long")).alias("n_anomalies"),
        *[F.sum(F.col(f"flag_{m}").cast("long")).alias(f"n_{m}") for m in methods],
        F.coalesce(F.avg(F.when(hit, F.col("votes"))), F.lit(0.0)).alias("average_agreement"))
    share = F.col("n_anomalies") / F.col("n_rows") * 100
    note = (F.when(F.col("n_anomalies") == 0, F.lit("no anomalies detected"))
            .when(share > 20, F.lit("more than 20% of the rows are flagged")))
    return got.withColumn("pct_anomalies", share).withColumn("warning", note) \
              .withColumn("status", F.when(note.isNull(), "ok").otherwise("warning"))

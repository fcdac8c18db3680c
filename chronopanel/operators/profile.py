"""Profiling aggregations: shape, columns, roles, distribution, frequency, warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalar import present
from ..shared import stage, stage_all
from .panel import Panel, numeric_order
from .quantiles import quantiles

HISTOGRAM_BINS = 50


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


def column_info(p: Panel, samples: int = 3, approx: bool = False) -> DataFrame:
    """One row per column: type, missing %, distinct non-null values, first values by time."""
    df, cols = p.df, p.df.columns
    kinds = dict(df.dtypes)
    nullish = lambda c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    value = lambda c: F.when(~nullish(c), F.col(c))
    distinct = F.approx_count_distinct if approx else F.count_distinct
    stats = df.agg(F.count(F.lit(1)).alias("__n"),
                   *[F.sum(nullish(c).cast("long")).alias(f"__m{i}") for i, c in enumerate(cols)],
                   *[distinct(value(c)).alias(f"__d{i}") for i, c in enumerate(cols)])
    stats = stats.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"),
        F.round(F.try_divide(F.col(f"__m{i}"), F.col("__n")) * 100, 2).alias("missing_pct"),
        F.col(f"__d{i}").cast("long").alias("unique_count")) for i, c in enumerate(cols)])).alias("s")).select("s.*")
    order = [F.col(c).asc_nulls_last() for c in (p.spec.time, *p.spec.tie)]
    # each column needs its own first few rows: small ordered limits, united
    heads = [df.where(~nullish(c)).orderBy(*order).limit(samples)
               .agg(F.array_sort(F.collect_list(F.struct(p.spec.time, *p.spec.tie, F.col(c).cast("string").alias("v")))).alias("__i"))
               .select(F.lit(c).alias("column"), F.transform("__i", lambda r: r["v"]).alias("sample_values")) for c in cols]
    return stats.join(reduce(DataFrame.unionByName, heads), "column", "left")


def column_roles(df: DataFrame) -> dict[str, list[str]]:
    """Datetime / numeric / categorical by type; a text column counts as datetime if it has a value
    and all its values parse as dates (one aggregate over all rows)."""
    roles: dict[str, list[str]] = {"datetime": [], "numeric": [], "categorical": []}
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    parsed = {}
    if text:
        dated = lambda c: F.when(F.col(c).isNotNull(), F.try_to_timestamp(F.col(c)).isNotNull())
        row = df.agg(*[F.coalesce(F.every(dated(c)), F.lit(False)).alias(c) for c in text]).first()
        parsed = row.asDict()
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) or parsed.get(f.name):
            roles["datetime"].append(f.name)
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            roles["numeric"].append(f.name)
        else:
            roles["categorical"].append(f.name)
    return roles


def category_values(df: DataFrame, columns, limit: int | None = 20) -> DataFrame:
    """Up to ``limit`` (None: all) smallest values of each categorical column: (column, value)."""
    parts = [df.where(F.col(c).isNotNull()).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).distinct() for c in columns]
    if limit is not None:
        parts = [d.orderBy("value").limit(limit) for d in parts]
    return reduce(DataFrame.unionByName, parts)


def missing_share(p: Panel) -> DataFrame:
    return p.aggregate((F.avg((~present(p.y)).cast("double")) * 100).alias("missing_pct"))


def moments(p: Panel) -> DataFrame:
    y = F.when(present(p.y), p.y)
    return p.aggregate(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"))


def date_range(p: Panel) -> DataFrame:
    return p.aggregate(F.min(p.spec.time).alias("first_ts"), F.max(p.spec.time).alias("last_ts"))


def quartile_bounds(p: Panel, k: float = 1.5, df: DataFrame | None = None, value: str | None = None) -> DataFrame:
    q = quantiles(p, value or p.spec.target, {"q1": 0.25, "q3": 0.75}, df)
    iqr = F.col("q3") - F.col("q1")
    return q.select(*p.keys, "q1", "q3", iqr.alias("iqr"), (F.col("q1") - k * iqr).alias("lower_bound"),
                    (F.col("q3") + k * iqr).alias("upper_bound"))


def outlier_share(p: Panel, k: float = 1.5) -> DataFrame:
    rows = p.attach(p.df.where(present(p.y)).select(*p.keys, p.y.alias("__v")), quartile_bounds(p, k))
    out = (F.col("__v") < F.col("lower_bound")) | (F.col("__v") > F.col("upper_bound"))
    return rows.groupBy(*p.keys).agg((F.avg(out.cast("double")) * 100).alias("outlier_pct"))


def frequency(p: Panel) -> DataFrame:
    """Constant step per series, else null: ``step_seconds``, ``frequency`` alias.

    Calendar months are recognized by their first or last day.  Fewer than three rows give null."""
    t = F.col(p.spec.time)
    stamp = t.cast("timestamp")
    value = numeric_order(p.df, p.spec.time)
    month = F.year(stamp) * 12 + F.month(stamp)
    d = p.over(lambda w: {"__gap": (value - F.lag(value).over(w)) / 1e6 if not isinstance(p.df.schema[p.spec.time].dataType, T.DateType)
                          else (value - F.lag(value).over(w)) * 86400,
                          "__mgap": month - F.lag(month).over(w)}, before=1,
               df=p.df.select(*p.keys, p.spec.time, *p.spec.tie))
    agg = d.groupBy(*p.keys).agg(
        F.min("__gap").alias("lo"), F.max("__gap").alias("hi"), F.count(F.lit(1)).alias("c"),
        F.min("__mgap").alias("mlo"), F.max("__mgap").alias("mhi"),
        F.max(F.dayofmonth(stamp)).alias("dmax"), F.min((stamp.cast("date") == F.last_day(stamp)).cast("int")).alias("month_end"))
    regular = (F.col("c") >= 3) & (F.col("lo") == F.col("hi")) & (F.col("lo") > 0)
    step = F.when(regular, F.col("lo"))
    monthly = (F.col("c") >= 3) & (F.col("mlo") == F.col("mhi")) & (F.col("mlo") > 0)
    return agg.select(*p.keys, step.cast("double").alias("step_seconds"),
                      F.when(regular, step_alias(step))
                       .when(monthly & (F.col("dmax") == 1), _times(F.col("mlo"), "MS"))
                       .when(monthly & (F.col("month_end") == 1), _times(F.col("mlo"), "ME")).alias("frequency"))


def _times(n: Column, unit: str) -> Column:
    return F.when(n == 1, F.lit(unit)).otherwise(F.concat(n.cast("long").cast("string"), F.lit(unit)))


def step_alias(step: Column) -> Column:
    """15min, h, 2h, D, ... from a step in seconds."""
    return (F.when(step % 86400 == 0, _times(step / 86400, "D")).when(step % 3600 == 0, _times(step / 3600, "h"))
            .when(step % 60 == 0, _times(step / 60, "min")).otherwise(_times(step, "s")))


def trend(p: Panel) -> DataFrame:
    """OLS slope on the position; a trend if |slope| > 0.01 std (ddof 0)."""
    clean = p.derive(p.df.where(present(p.y)).select(*p.keys, p.spec.time, *p.spec.tie, p.spec.target))
    ix = clean.indexed()
    got = ix.groupBy(*p.keys).agg(F.regr_slope(p.y, F.col("idx").cast("double")).alias("slope"), F.stddev_pop(p.y).alias("std"))
    return got.select(*p.keys, "slope", F.coalesce(F.abs("slope") > 0.01 * F.col("std"), F.lit(False)).alias("has_trend"))


def histogram(p: Panel, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins of the target: (keys, bin, lower, upper, count), empty bins included."""
    rows = p.df.where(present(p.y)).select(*p.keys, p.y.alias("__v"))
    ends = rows.groupBy(*p.keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    ends = ends.withColumn("__w", (F.col("__hi") - F.col("__lo")) / bins)
    place = F.when(F.col("__w") > 0, F.least(F.floor((F.col("__v") - F.col("__lo")) / F.col("__w")), F.lit(bins - 1))).otherwise(0)
    counted = p.attach(rows, ends).groupBy(*p.keys, place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = ends.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    from ..shared import key_join
    return key_join(grid, counted, [*p.keys, "bin"], "left").select(
        *p.keys, "bin", (F.col("__lo") + F.col("bin") * F.col("__w")).alias("lower"),
        (F.col("__lo") + (F.col("bin") + 1) * F.col("__w")).alias("upper"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def box_statistics(p: Panel) -> DataFrame:
    """Quartiles, whiskers (furthest values inside 1.5 iqr) and the number of outliers."""
    q = quantiles(p, p.spec.target, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    q = q.select("*", (F.col("q1") - 1.5 * iqr).alias("__lo"), (F.col("q3") + 1.5 * iqr).alias("__hi"))
    rows = p.attach(p.df.where(present(p.y)).select(*p.keys, p.y.alias("__v")), q)
    inside = F.col("__v").between(F.col("__lo"), F.col("__hi"))
    got = rows.groupBy(*p.keys).agg(
        *[F.min(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col("__v"))).alias("whisker_low"), F.max(F.when(inside, F.col("__v"))).alias("whisker_high"),
        F.sum((~inside).cast("long")).alias("n_outliers"))
    return got


def data_warnings(profile: DataFrame) -> DataFrame:
    """``status`` and ``warnings`` from missing_pct (> 10) and outlier_pct (> 5)."""
    notes = F.array_compact(F.array(
        F.when(F.col("missing_pct") > 10, F.format_string("high missing data (%.1f%%)", "missing_pct")),
        F.when(F.col("outlier_pct") > 5, F.format_string("high outlier rate (%.1f%%)", "outlier_pct"))))
    return profile.withColumn("warnings", notes).withColumn("status", F.when(F.size("warnings") > 0, "warning").otherwise("ok"))


def _simple(p: Panel) -> list[Column]:
    """Everything one plain aggregation gives: rows, dates, missing share, moments."""
    y = F.when(present(p.y), p.y)
    return [F.count(F.lit(1)).alias("n_rows"), F.min(p.spec.time).alias("first_ts"), F.max(p.spec.time).alias("last_ts"),
            (F.avg((~present(p.y)).cast("double")) * 100).alias("missing_pct"),
            F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max")]


def profile(p: Panel, stationarity: bool = True, seasonality: bool = True) -> DataFrame:
    """The whole profile, one row per series."""
    from .autocorrelation import seasonality_flag
    from .stationarity import adf, kpss
    simple = p.aggregate(*_simple(p))
    flag = None
    parts = [frequency(p), outlier_share(p), trend(p)]
    if stationarity:
        parts += [adf(p).select(*p.keys, "adf_statistic", "adf_pvalue"), kpss(p).select(*p.keys, "kpss_statistic", "kpss_pvalue")]
    if seasonality:
        from .decompose import seasonal_period
        flag = stage(seasonality_flag(p), "seasonality")
        parts.append(seasonal_period(p, flag=flag))
    # each part is one row per series: computed as its own job, then joined
    out = reduce(lambda a, b: p.attach(a, b, "left"), stage_all([simple, seasonality_flag(p) if flag is None else flag, *parts], "profile"))
    return data_warnings(out.withColumn("n_cols", F.lit(len(p.df.columns))))

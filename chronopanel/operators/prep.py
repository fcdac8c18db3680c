"""Projections, filters and preparation of a panel."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalar import clip, present
from .panel import Panel


def parse_time(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    return df.withColumn(column, F.to_timestamp(column, fmt) if fmt else F.to_timestamp(column))


def sort_output(df: DataFrame, *columns: str) -> DataFrame:
    """For output only; operators order inside their own windows."""
    return df.orderBy(*columns)


def _literal(kind: T.DataType, value):
    """``value`` as a literal of the column's own type, or None if it is not one: a plain
    comparison can be pushed to the scan, a cast of the column cannot."""
    try:
        if isinstance(kind, T.StringType):
            return F.lit(str(value))
        if isinstance(kind, T.BooleanType):
            return F.lit({"true": True, "false": False}[str(value).lower()])
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return F.lit(int(str(value)))
        if isinstance(kind, T.NumericType):
            return F.lit(float(str(value)))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            parsed = value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
            return F.lit(parsed).cast(kind)
    except (ValueError, KeyError):
        return None
    return None


def predicate(df: DataFrame, column: str, op: str, value) -> Column | None:
    """One filter as a Column; None where the column or the operator is unknown (skipped). A value that
    cannot be compared with the column raises."""
    if column not in df.columns:
        return None
    kind, c = df.schema[column].dataType, F.col(column)
    if op in ("==", "!="):
        lit = _literal(kind, value)
        same = c == lit if lit is not None else c.cast("string") == F.lit(str(value))
        return same if op == "==" else ~same | c.isNull()  # text comparison keeps missing values
    if op in ("in", "between"):
        lits = [_literal(kind, v) for v in value]
        if any(v is None for v in lits):
            raise ValueError(f"{value!r} does not fit column {column} ({kind.simpleString()})")
        return c.isin(*lits) if op == "in" else c.between(*lits)
    lit = _literal(kind, value)
    if lit is None:
        raise ValueError(f"{value!r} does not fit column {column} ({kind.simpleString()})")
    return {"<": c < lit, "<=": c <= lit, ">": c > lit, ">=": c >= lit}.get(op)


def apply_filters(df: DataFrame, filters) -> DataFrame:
    """AND of ``(column, op, value)`` triples or dicts with those fields."""
    for f in filters or ():
        column, op, value = (f["column"], f.get("op", "=="), f["value"]) if isinstance(f, dict) else f
        cond = predicate(df, column, op, value)
        if cond is not None:
            df = df.where(cond)
    return df


def require_rows(df: DataFrame) -> DataFrame:
    """Fail if nothing is left (runs a job that stops at the first row)."""
    if df.isEmpty():
        raise ValueError("no rows are left after the filters")
    return df


def select_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    return df.select(*columns)


def keep_known(df: DataFrame, columns) -> list[str]:
    """The requested columns that exist; unknown ones are dropped from a plan."""
    return [c for c in columns if c in df.columns]


def trim_leading(p: Panel) -> Panel:
    """Drop the null/zero rows before the first non-null, non-zero target of each series.
    A series without such a row is kept whole."""
    place = F.struct(p.spec.time, *p.spec.tie)
    first = p.aggregate(F.min(F.when(present(p.y) & (p.y != 0), place)).alias("__first"))
    out = p.attach(p.df, first).where(F.col("__first").isNull() | (place >= F.col("__first")))
    return p.derive(out.drop("__first"))


def drop_missing_target(p: Panel) -> Panel:
    return p.derive(p.df.where(present(p.y)))


def complete_cases(p: Panel) -> Panel:
    """Rows in which the target and every feature are present."""
    df = p.df
    for c in (p.spec.target, *p.spec.features):
        df = df.where(present(F.col(c)))
    return p.derive(df)


def split(p: Panel, fraction: float = 0.8, df: DataFrame | None = None) -> DataFrame:
    """``is_train`` on the first floor(fraction*n) rows of each series."""
    return p.indexed(df).withColumn("is_train", F.col("idx") < F.floor(F.col("n") * F.lit(fraction)))


def head_rows(p: Panel, n: int = 10) -> DataFrame:
    """First n rows of the table by time, every value as text."""
    d = p.df.orderBy(*[F.col(c).asc_nulls_last() for c in (p.spec.time, *p.spec.tie)]).limit(n)
    return d.select(*[F.col(c).cast("string").alias(c) for c in d.columns])


def clip_to_actuals(pred: DataFrame, keys, actual: str = "y", yhat: str = "yhat", margin: float = 50.0) -> DataFrame:
    """Clip forecasts to [min(actual)-margin, max(actual)+margin] of their group."""
    from ..shared import key_join
    bounds = pred.groupBy(*keys).agg(F.min(actual).alias("__lo"), F.max(actual).alias("__hi"))
    out = key_join(pred, bounds, keys)
    return out.withColumn(yhat, clip(F.col(yhat), F.col("__lo") - margin, F.col("__hi") + margin)).drop("__lo", "__hi")


def standardize(p: Panel, columns, suffix: str = "_z", df: DataFrame | None = None) -> DataFrame:
    """(x - mean)/std with ddof 0; a zero std divides by 1."""
    src = p.df if df is None else df
    stats = p.aggregate(*[e for c in columns for e in (
        F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))], df=src)
    out = p.attach(src, stats)
    out = out.select("*", *[((F.col(c) - F.col(f"__m_{c}")) /
                             F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}"))).alias(c + suffix)
                            for c in columns])
    return out.drop(*[f"__{x}_{c}" for c in columns for x in "ms"])


def future_frame(p: Panel, horizon: int, step_seconds: int | None = None) -> DataFrame:
    """``horizon`` rows after the end of each series: (keys, h, time).

    Without ``step_seconds`` the step is the inferred frequency, or the mean step rounded to
    seconds where the series is irregular."""
    t = F.col(p.spec.time)
    secs = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    ends = p.aggregate(F.max(t).alias("__last"), F.min(t).alias("__first"), F.count(F.lit(1)).alias("__n"))
    if step_seconds is None:
        from .profile import frequency
        ends = p.attach(ends, frequency(p).select(*p.keys, "step_seconds"), "left")
        mean = F.round(F.try_divide(secs(F.col("__last")) - secs(F.col("__first")), F.col("__n") - 1))
        step = F.coalesce(F.col("step_seconds"), mean, F.lit(1)).cast("long")
    else:
        step = F.lit(step_seconds).cast("long")
    steps = ends.select(*p.keys, "__last", step.alias("__step"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    at = F.col("__last") + F.make_dt_interval(secs=(F.col("__step") * F.col("h")).cast("decimal(18,6)"))
    return steps.select(*p.keys, "h", at.alias(p.spec.time))


def steps_per_day(step_seconds: Column) -> Column:
    """Whole steps per day from the step in seconds; at least 1, and 1 where unknown."""
    return F.coalesce(F.greatest(F.floor(F.lit(86400) / step_seconds), F.lit(1)), F.lit(1)).cast("long")

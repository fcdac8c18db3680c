"""The series the registered queries work on, derived from the given tables, and the SQL that
defines the same series."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.panel import Panel
from ..shared import on_release, stage
from ..spec import SeriesSpec

#: added before rounding on both sides: averages of two-decimal values often end exactly on a
#: rounding tie, where the last bit of a float sum would decide
NUDGE = 3.1e-9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_staged: dict[tuple, Panel] = {}
on_release.append(_staged.clear)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = re.sub(r", (\d+)\) \+ 0\.0", rf" + {NUDGE}, \1) + 0.0", sql)
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (no negative zero), integers as bigint: the form the SQL gives too."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c + NUDGE, digits) + 0.0
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def _version(spark: SparkSession, sf: str) -> tuple:
    """The files of the tables with their size and time: new data under an old path are new tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime())
                        for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)))


def _once(spark: SparkSession, sf: str, name: str, build: Callable[[], Panel]) -> Panel:
    key = (spark.sparkContext.applicationId, sf, _version(spark, sf), name)
    if key not in _staged:
        _staged[key] = build().staged(name)
    return _staged[key]


def kept(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """An intermediate table several queries share, written once per session."""
    key = (spark.sparkContext.applicationId, sf, _version(spark, sf), name)
    if key not in _staged:
        _staged[key] = stage(build(), name)
    return _staged[key]


def fitted(spark: SparkSession, sf: str, name: str, build: Callable[[], object]):
    """A model several queries share, fitted once per session."""
    key = (spark.sparkContext.applicationId, sf, _version(spark, sf), "model", name)
    if key not in _staged:
        _staged[key] = build()
    return _staged[key]


HOUR = "make_timestamp_ntz(year(ts), month(ts), day(ts), hour(ts), 0, 0)"


def hourly(spark: SparkSession, sf: str, features: bool = False) -> Panel:
    """Hourly mean of events.value per event type, with row and user counts as features."""
    def build():
        df = table(spark, sf, "events").groupBy("event_type", F.expr(HOUR).alias("ts")).agg(
            F.avg("value").alias("y"), F.count(F.lit(1)).cast("double").alias("cnt"), F.count_distinct("user_id").cast("double").alias("users"))
        return Panel(df, SeriesSpec(keys=("event_type",)))
    p = _once(spark, sf, "hourly", build)
    return p.derive(p.df, features=("cnt", "users")) if features else p


HOURLY = """hourly AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS y, count(*)::DOUBLE AS cnt,
  count(DISTINCT user_id)::DOUBLE AS users FROM events GROUP BY 1, 2)"""
IX = HOURLY + """, ix AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS idx,
  count(*) OVER (PARTITION BY event_type) AS n FROM hourly)"""


def daily(spark: SparkSession, sf: str) -> Panel:
    """Daily order value, one series."""
    def build():
        df = table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg((F.sum("o_totalprice") / 1e6).alias("y"))
        return Panel(df, SeriesSpec())
    return _once(spark, sf, "daily", build)


DAILY = "daily AS (SELECT o_orderdate AS ts, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY 1)"
DIX = DAILY + ", ix AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS idx, count(*) OVER () AS n FROM daily)"


def shipped(spark: SparkSession, sf: str) -> Panel:
    """Daily shipments per return flag with price and discount as features."""
    def build():
        df = table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_shipdate").alias("ts")).agg(
            F.sum("l_quantity").alias("y"), (F.sum("l_extendedprice") / 1e6).alias("price"), F.avg("l_discount").alias("discount"))
        return Panel(df, SeriesSpec(keys=("l_returnflag",), features=("price", "discount")))
    return _once(spark, sf, "shipped", build)


SHIPPED = """shipped AS (SELECT l_returnflag, l_shipdate AS ts, sum(l_quantity) AS y, sum(l_extendedprice) / 1e6 AS price,
  avg(l_discount) AS discount FROM lineitem GROUP BY 1, 2)"""


def raw(spark: SparkSession, sf: str) -> Panel:
    """The event values themselves, one series per event type, read from the table."""
    return Panel(table(spark, sf, "events"), SeriesSpec(target="value", keys=("event_type",), tie=("event_id",)))


RIX = """ix AS (SELECT *, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)"""

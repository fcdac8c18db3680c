"""Panel: a DataFrame of many series, and ordered work over it that never puts a whole long
series into one task.

Two measured facts steer every plan: the number of series and the rows of the longest one.
They come from one ``count`` per key, run once per panel.

* Per-series tables (one row per key) are broadcast only if the measured number of series is
  small, and joined otherwise.
* If the longest series fits ``block_rows``, ordered windows partition by the keys.  If not,
  the time range of each series is cut into buckets, the bucket counts are cumulated, and
  consecutive buckets form blocks of about ``block_rows`` rows; rows near a border are also
  copied to the neighbour block so that row frames are complete.  Windows then partition by
  (keys, block): one hot series spreads over many tasks and the result is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..shared import BROADCAST_CELLS, BROADCAST_ROWS, key_join, stage
from ..spec import SeriesSpec

COARSE_BUCKETS = 1_024
MAX_BUCKETS = 65_536  # per coarse bucket
BUCKETS_PER_BLOCK = 8


def numeric_order(df: DataFrame, col: str) -> Column:
    kind = df.schema[col].dataType
    c = F.col(col)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double")


class Panel:
    def __init__(self, df: DataFrame, spec: SeriesSpec, _sizes: tuple[int, int] | None = None):
        self.df, self.spec = df, spec
        self._sizes = _sizes

    # ---- facts -------------------------------------------------------------------------
    @property
    def keys(self) -> list[str]:
        return list(self.spec.keys)

    def _measure(self) -> tuple[int, int]:
        if self._sizes is None:
            per_key = self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"))
            row = per_key.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).first()
            self._sizes = (int(row["k"] or 0), int(row["n"] or 0))
        return self._sizes

    @property
    def n_series(self) -> int:
        return self._measure()[0]

    @property
    def longest(self) -> int:
        return self._measure()[1]

    @property
    def y(self) -> Column:
        return F.col(self.spec.target)

    def derive(self, df: DataFrame, **changes) -> "Panel":
        """Other columns, and the same rows or fewer: keeps the measured sizes, which stay upper bounds."""
        spec = SeriesSpec(**{**self.spec.__dict__, **changes})
        keep = self._sizes if spec.keys == self.spec.keys else None
        return Panel(df, spec, keep)

    def fresh(self, df: DataFrame, **changes) -> "Panel":
        """Other rows: sizes are measured again."""
        return Panel(df, SeriesSpec(**{**self.spec.__dict__, **changes}))

    def staged(self, name: str = "panel") -> "Panel":
        """The panel written once to the shared folder.  Worth it for a computed target (a
        roll-up): later passes read the small table, and all see the same float values."""
        return self.derive(stage(self.df, name))

    # ---- per-series tables -------------------------------------------------------------
    def attach(self, df: DataFrame, per_key: DataFrame, how: str = "inner", cells: int = 8) -> DataFrame:
        """Add the columns of a one-row-per-series table to ``df``.  ``cells``: values per row
        (array lengths included); the table is broadcast only if all of them are few."""
        if self.n_series * cells <= BROADCAST_CELLS:
            per_key = F.broadcast(per_key)
        return key_join(df, per_key, self.keys, how)

    def aggregate(self, *exprs: Column, df: DataFrame | None = None) -> DataFrame:
        return (self.df if df is None else df).groupBy(*self.keys).agg(*exprs)

    # ---- ordered work ------------------------------------------------------------------
    def _order(self, order: str, tie) -> list[Column]:
        return [F.col(c).asc_nulls_last() for c in (order, *tie)]

    def _buckets(self, df: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
        """Cut the order range of each series into buckets: the rows with ``n`` and ``__bucket``,
        and per bucket the positions [__start, __end) of its rows.

        Two rounds of equal-width cuts: the second one cuts each coarse bucket over its own
        range by its own count, so bursts of rows and stray time stamps do not make a bucket
        large."""
        rows, v = self.spec.block_rows, F.col("__order")
        pieces = lambda c, most: F.least(F.greatest(F.ceil(c * BUCKETS_PER_BLOCK / rows), F.lit(1)), F.lit(most)).cast("long")
        place = lambda lo, hi, count: F.coalesce(
            F.when(hi > lo, F.least(count - 1, F.floor((v - lo) / ((hi - lo) / count)))),
            F.when(v.isNull(), count - 1), F.lit(0)).cast("long")
        df = df.withColumn("__order", numeric_order(df, order))
        stats = df.groupBy(*self.keys).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"), F.count(F.lit(1)).alias("n"))
        coarse = self.attach(df, stats.withColumn("__count", pieces(F.col("n"), COARSE_BUCKETS)))
        coarse = coarse.withColumn("__coarse", place(F.col("__lo"), F.col("__hi"), F.col("__count"))).drop("__lo", "__hi", "__count")
        spread = coarse.groupBy(*self.keys, "__coarse").agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"), F.count(F.lit(1)).alias("__c"))
        spread = spread.withColumn("__count", pieces(F.col("__c"), MAX_BUCKETS)).drop("__c")
        if self.n_series * min(COARSE_BUCKETS, self.longest * BUCKETS_PER_BLOCK // rows + 1) <= BROADCAST_ROWS:
            spread = F.broadcast(spread)
        tagged = key_join(coarse, spread, [*self.keys, "__coarse"])
        fine = F.col("__coarse") * MAX_BUCKETS + place(F.col("__lo"), F.col("__hi"), F.col("__count"))
        tagged = tagged.withColumn("__bucket", fine).drop("__order", "__coarse", "__lo", "__hi", "__count")
        hist = tagged.groupBy(*self.keys, "__bucket").agg(F.count(F.lit(1)).alias("__c"), F.min("n").alias("n"))
        along = Window.partitionBy(*self.keys).orderBy("__bucket")
        hist = hist.withColumn("__end", F.sum("__c").over(along)).withColumn("__start", F.col("__end") - F.col("__c"))
        return tagged, hist

    def tail(self, size: int, df: DataFrame | None = None) -> DataFrame:
        """The last ``size`` rows of each series with ``idx`` and ``n``.  In a long series only
        the buckets that reach into the tail are shuffled."""
        df = self.df if df is None else df
        if self.longest <= self.spec.block_rows:
            return self.indexed(df).where(F.col("idx") >= F.col("n") - size)
        tagged, hist = self._buckets(df, self.spec.time)
        cut = hist.where(F.col("__end") > F.col("n") - size).groupBy(*self.keys).agg(
            F.min("__bucket").alias("__from"), F.min("__start").alias("__base"))
        late = self.attach(tagged, cut).where(F.col("__bucket") >= F.col("__from"))
        w = Window.partitionBy(*self.keys).orderBy(*self._order(self.spec.time, self.spec.tie))
        late = late.withColumn("idx", (F.col("__base") + F.row_number().over(w) - 1).cast("long"))
        return late.drop("__bucket", "__from", "__base").where(F.col("idx") >= F.col("n") - size)

    def blocked(self, before: int = 0, after: int = 0, order: str | None = None,
                tie: tuple[str, ...] | None = None, df: DataFrame | None = None):
        """Cut into ordered blocks.

        Returns ``(df, window)``: ``df`` has ``idx`` (0-based position in the series), ``n``
        (rows of the series), ``__block`` and ``__core`` (false on copied border rows), and
        ``window`` orders the rows of one block.  Frames reaching up to ``before`` rows back
        and ``after`` rows ahead are complete on core rows.
        """
        df = self.df if df is None else df
        order = order or self.spec.time
        tie = self.spec.tie if tie is None else tie
        rows = self.spec.block_rows
        sort = self._order(order, tie)
        if self.longest <= rows:
            w = Window.partitionBy(*self.keys, "__block").orderBy(*sort)
            all_rows = Window.partitionBy(*self.keys, "__block")
            out = df.withColumn("__block", F.lit(0).cast("long"))
            out = out.select("*", F.lit(True).alias("__core"),
                             (F.row_number().over(w) - 1).cast("long").alias("idx"),
                             F.count(F.lit(1)).over(all_rows).alias("n"))
            return out, w
        by = [*self.keys, "__bucket"]
        along = Window.partitionBy(*self.keys).orderBy("__bucket")
        tagged, hist = self._buckets(df, order)
        hist = hist.withColumn("__own", F.floor(F.col("__start") / rows).cast("long"))
        targets = [F.array("__own")]
        if before:
            hist = hist.withColumn("__next", F.lead("__own").over(along))
            ahead = Window.partitionBy(*self.keys).orderBy("__end").rangeBetween(0, before - 1)
            hist = hist.withColumn("__b", F.collect_set("__next").over(ahead))
            targets.append(F.col("__b"))
        if after:
            hist = hist.withColumn("__prev", F.lag("__own").over(along))
            behind = Window.partitionBy(*self.keys).orderBy("__start").rangeBetween(-(after - 1), 0)
            hist = hist.withColumn("__a", F.collect_set("__prev").over(behind))
            targets.append(F.col("__a"))
        plan = hist.select(*by, "__own", "__start", F.explode(F.array_distinct(F.concat(*targets))).alias("__block"))
        first = Window.partitionBy(*self.keys, "__block")
        plan = plan.select(*by, "__block", (F.col("__block") == F.col("__own")).alias("__core"),
                           F.min("__start").over(first).alias("__base"))
        bound = self.n_series * (COARSE_BUCKETS + 2 * (self.longest * BUCKETS_PER_BLOCK // rows + 1)) * 3
        if bound <= BROADCAST_ROWS:
            plan = F.broadcast(plan)
        out = key_join(tagged, plan, by).drop("__bucket")
        w = Window.partitionBy(*self.keys, "__block").orderBy(*sort)
        out = out.withColumn("idx", (F.col("__base") + F.row_number().over(w) - 1).cast("long")).drop("__base")
        return out, w

    def over(self, *steps: Callable[[Window], dict[str, Column]], before: int = 0, after: int = 0,
             order: str | None = None, tie: tuple[str, ...] | None = None,
             df: DataFrame | None = None) -> DataFrame:
        """Add window columns.  Each step maps the ordered window to named columns; later
        steps may use the columns of earlier ones.  ``before``/``after`` is the total reach
        of all steps.  ``idx`` and ``n`` are added as well."""
        out, w = self.blocked(before, after, order, tie, df)
        for step in steps:
            out = out.select("*", *[c.alias(name) for name, c in step(w).items()])
        return out.where("__core").drop("__block", "__core")

    def indexed(self, df: DataFrame | None = None) -> DataFrame:
        """P10: position ``idx`` and length ``n``."""
        return self.over(df=df)


"""Registered queries whose SQL states what must hold of a result that SQL itself cannot compute, and
queries of whole paths (filters, folds, searches) with the rows they must give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import decompose, isolation_forest, prep, registry, smoothing, stationarity, trees, validation
from ..sources import files
from .data import HOURLY, IX, SHIPPED, fitted, hourly, query, rounded, shipped, table
from .forecasts import _MODELS, FRAME, H, SCORES
from .series import _COLS

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("s4_file_rows", " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) AS n FROM {t}" for t in _TABLES))
def _(spark, sf):
    listed = files.list_data_files(spark, sf).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    rows = [table(spark, sf, t).select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n")) for t in _TABLES]
    return listed.join(reduce(DataFrame.unionByName, rows), "file")


@query("s5_column_names", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n FROM events" for c in _COLS))
def _(spark, sf):
    df = table(spark, sf, "events")
    counts = df.agg(*[F.count(c).alias(c) for c in files.column_names(df)])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*df.columns))).alias("column", "n"))


@query("p4_filtered_columns", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
def _(spark, sf):
    kept = prep.require_rows(prep.apply_filters(table(spark, sf, "orders"), [("o_orderpriority", "==", "1-URGENT"), {"column": "o_totalprice", "op": ">", "value": 100000}]))
    return prep.select_columns(kept, prep.keep_known(kept, ["o_orderkey", "o_orderdate", "missing", "o_totalprice"]))


@query("v2_folds_without_short", f"""WITH {HOURLY} SELECT event_type, fold, origin, 40::BIGINT AS fold_h FROM (
    SELECT event_type, f::BIGINT AS fold, n, (80 + f * greatest(1, floor((n - 120) / 3)))::BIGINT AS origin FROM (
      SELECT event_type, count(*) AS n FROM hourly WHERE event_type < 'p' OR ts < TIMESTAMP '2024-01-04' GROUP BY 1), range(3) f(f) WHERE n >= 120) WHERE origin + 40 <= n""")
def _(spark, sf):
    p = hourly(spark, sf)
    return validation.folds(p.fresh(p.df.where("event_type < 'p' OR ts < timestamp_ntz'2024-01-04 00:00:00'")), 40, short=False)


_GRID = {f"S{s:02d}": s for s in registry.MODELS["SeasonalNaive"].grid["seasonal_period"]}
_GRID_SQL = "(VALUES " + ", ".join(f"('{m}', {s})" for m, s in _GRID.items()) + ") m(model, sp)"


@query("k5_whole_grid", f"""WITH {SCORES.replace(_MODELS, _GRID_SQL)}, best AS (SELECT * FROM ranked WHERE rank_no = 1)
  SELECT b.event_type, h::BIGINT AS h, round(x.y, 6) + 0.0 AS yhat, round(b.mean_mape, 6) + 0.0 AS mean_mape
  FROM best b JOIN {_GRID_SQL} ON m.model = b.model CROSS JOIN {FRAME} JOIN ix x ON x.event_type = b.event_type AND x.idx = x.n - m.sp + (h - 1) % m.sp""")
def _(spark, sf):
    p = hourly(spark, sf)
    got = registry.train_and_forecast(p, "SeasonalNaive", H)
    return rounded(p.attach(got["forecasts"].select("event_type", "h", "yhat"), got["scores"].select("event_type", "mean_mape")))


@query("t6_stl_adds_up", f"WITH {HOURLY} SELECT event_type, count(*) AS n, true AS adds_up, true AS centred FROM hourly GROUP BY 1")
def _(spark, sf):
    d = decompose.stl(hourly(spark, sf), 24)
    whole = F.abs(F.col("trend") + F.col("seasonal") + F.col("resid") - F.col("y")) < 1e-9
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.every(whole).alias("adds_up"),
                                       (F.abs(F.avg("seasonal")) < 0.1 * F.stddev_samp("y")).alias("centred"))


@query("t5_kpss_lags", f"""WITH {IX}, e AS (SELECT event_type, idx, n, y - avg(y) OVER (PARTITION BY event_type) AS e FROM ix),
  c AS (SELECT x.event_type, l, any_value(x.n) AS n, sum(x.e * z.e) AS c FROM e x JOIN range(0, 12) t(l) ON l <= floor(pow(x.n, 2.0 / 9) + 1e-9) JOIN e z ON z.event_type = x.event_type AND z.idx = x.idx - l GROUP BY 1, 2),
  s AS (SELECT event_type, any_value(n) AS n, sum(CASE WHEN l = 0 THEN c / n ELSE 2 * c / n END) AS s0, sum(2 * l * c / n) AS s1 FROM c GROUP BY 1)
  SELECT event_type, least(floor(1.1447 * pow((s1 / s0) * (s1 / s0), 1.0 / 3) * pow(n, 1.0 / 3)), n - 1)::BIGINT AS kpss_lags FROM s""")
def _(spark, sf):
    return stationarity.kpss(hourly(spark, sf)).select("event_type", "kpss_lags")


@query("m4_ets_fixed", f"""WITH RECURSIVE {IX}, s AS (
    SELECT a.event_type, -1::BIGINT AS idx, a.n, a.y::DOUBLE AS level, (b.y - a.y)::DOUBLE AS slope FROM ix a JOIN ix b ON a.event_type = b.event_type AND a.idx = 0 AND b.idx = 1
    UNION ALL SELECT s.event_type, x.idx, s.n, 0.3 * x.y + 0.7 * (level + slope), 0.1 * (0.3 * x.y + 0.7 * (level + slope) - level) + 0.9 * slope
    FROM s JOIN ix x ON x.event_type = s.event_type AND x.idx = s.idx + 1)
  SELECT event_type, h::BIGINT AS h, round(level + h * slope, 6) + 0.0 AS yhat FROM s CROSS JOIN {FRAME} WHERE idx = n - 1""")
def _(spark, sf):
    return rounded(smoothing.ets(hourly(spark, sf), H, "add", "none", parameters=(0.3, 0.1, 0.0)).drop("fallback"))


@query("a6_share", f"WITH {HOURLY} SELECT event_type, count(*) AS n, true AS few_flagged, true AS scores_in_range FROM hourly GROUP BY 1")
def _(spark, sf):
    p = hourly(spark, sf)
    d = isolation_forest.isolation_forest(p, p.df)
    n = F.count(F.lit(1))
    return d.groupBy("event_type").agg(n.alias("n"), (F.count_if("flag_iforest") <= F.floor(0.02 * n) + 1).alias("few_flagged"),
                                       F.every(F.col("score_iforest").between(0, 1)).alias("scores_in_range"))


@query("e5_additivity", f"WITH {SHIPPED} SELECT l_returnflag, count(*) AS n, true AS adds_up FROM shipped GROUP BY 1")
def _(spark, sf):
    p = shipped(spark, sf)
    model = fitted(spark, sf, "forest", lambda: trees.fit_feature_trees(p, "forest"))
    parts = trees.shap_values(model, p.df, ("l_returnflag", "ts")).groupBy("l_returnflag", "ts").agg((F.sum("shap") + F.max("base")).alias("total"))
    both = trees.predict_features(model, p.df).select("l_returnflag", "ts", "yhat").join(parts, ["l_returnflag", "ts"])
    return both.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.every(F.abs(F.col("total") - F.col("yhat")) < 1e-6).alias("adds_up"))

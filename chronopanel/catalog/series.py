"""Registered queries: sources, preparation, profiling, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalar import clip, finite, guarded_divide
from ..operators import autocorrelation as ac, decompose, prep, profile, ranking, stationarity
from ..operators.panel import Panel
from ..shared import scratch_dir
from ..sources import files
from .data import (DAILY, NUDGE, DIX, HOURLY, IX, RIX, SHIPPED, daily, hourly, query, r, raw, rounded, shipped, table)

K = "PARTITION BY event_type ORDER BY ts"


@query("s1_s6_csv_round_trip", f"WITH {DAILY} SELECT ts, {r('y', digits=4)} FROM daily")
def _(spark, sf):
    path = f"{scratch_dir(spark)}/daily-{uuid.uuid4().hex}.csv"
    files.write_table(daily(spark, sf).df, path, "csv")
    back = files.read_series(spark, path, time="ts")
    return rounded(back.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "y"), 4)


@query("s2_s3_read_parquet", "SELECT event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1")
def _(spark, sf):
    df = files.read_series(spark, f"{sf}/events.parquet")
    return rounded(df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


@query("s4_list_files")
def _(spark, sf):
    return files.list_data_files(spark, sf).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "suffix")


@query("s7_result_table", f"WITH {SHIPPED} SELECT l_returnflag, count(*) AS n, {r('sum_y', digits=2)} FROM (SELECT l_returnflag, y, sum(y) OVER (PARTITION BY l_returnflag) AS sum_y FROM shipped) GROUP BY l_returnflag, sum_y")
def _(spark, sf):
    path = f"{scratch_dir(spark)}/result-{uuid.uuid4().hex}"
    got = shipped(spark, sf).df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y"))
    files.write_table(got, path, "parquet", partition_by=("l_returnflag",))
    back = files.read_parquet(spark, path)
    return rounded(back.select(F.col("l_returnflag").cast("string"), "n", "sum_y"), 2)


@query("p1_parse_time", "SELECT event_id, ts FROM events")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.col("ts").cast("string").alias("ts"))
    return prep.parse_time(df, "ts").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("p2_sorted_output", f"WITH {DAILY} SELECT ts, {r('y', digits=4)} FROM daily ORDER BY ts")
def _(spark, sf):
    return prep.sort_output(rounded(daily(spark, sf).df, 4), "ts")


@query("p3_p8_filters", """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'
  AND o_custkey = 7 AND o_totalprice >= 1000.5 AND o_orderdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '2000-12-31'""")
def _(spark, sf):
    df = prep.apply_filters(table(spark, sf, "orders"), [
        {"column": "o_orderstatus", "op": "==", "value": "O"}, ("o_orderpriority", "!=", "5-LOW"), ("o_custkey", "==", "7"),
        ("o_totalprice", ">=", 1000.5), ("o_orderdate", "between", ("1995-03-01", "2000-12-31")), ("no_such", "==", 1)])
    return prep.select_columns(df, ["o_orderkey", "o_orderdate"])


@query("p5_trim_leading", f"""WITH {HOURLY}, z AS (SELECT event_type, ts, CASE WHEN ts < TIMESTAMP '2024-01-02 06:00:00' AND event_type <> 'view' THEN 0.0
    WHEN event_type = 'error' THEN 0.0 ELSE y END AS y FROM hourly),
  f AS (SELECT event_type, min(CASE WHEN y IS NOT NULL AND y <> 0 THEN ts END) AS f FROM z GROUP BY 1)
  SELECT z.event_type, z.ts, {r('y')} FROM z JOIN f USING (event_type) WHERE f.f IS NULL OR z.ts >= f.f""")
def _(spark, sf):
    p = hourly(spark, sf)
    zero = ((F.col("ts") < F.expr("timestamp_ntz'2024-01-02 06:00:00'")) & (F.col("event_type") != "view")) | (F.col("event_type") == "error")
    z = p.derive(p.df.select("event_type", "ts", F.when(zero, 0.0).otherwise(F.col("y")).alias("y")))
    return rounded(prep.trim_leading(z).df)


@query("p6_drop_missing", f"WITH {HOURLY} SELECT event_type, ts, {r('y')} FROM (SELECT event_type, ts, CASE WHEN cnt > 3 THEN NULL ELSE y END AS y FROM hourly) WHERE y IS NOT NULL")
def _(spark, sf):
    p = hourly(spark, sf)
    q = p.derive(p.df.select("event_type", "ts", F.when(F.col("cnt") > 3, None).otherwise(F.col("y")).alias("y")))
    return rounded(prep.drop_missing_target(q).df)


@query("p7_complete_cases", f"WITH {HOURLY} SELECT event_type, ts, {r('y', 'cnt', 'users')} FROM (SELECT event_type, ts, y, nullif(cnt, 1) AS cnt, nullif(users, 2) AS users FROM hourly) WHERE cnt IS NOT NULL AND users IS NOT NULL")
def _(spark, sf):
    p = hourly(spark, sf, True)
    q = p.derive(p.df.select("event_type", "ts", "y", F.nullif("cnt", F.lit(1.0)).alias("cnt"), F.nullif("users", F.lit(2.0)).alias("users")))
    return rounded(prep.complete_cases(q).df)


@query("p9_p10_split", f"WITH {RIX} SELECT event_id, idx, n, idx < floor(n * 0.8) AS is_train FROM ix")
def _(spark, sf):
    return prep.split(raw(spark, sf)).select("event_id", "idx", "n", "is_train")


@query("p11_head_rows", f"WITH {DAILY} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM daily ORDER BY daily.ts LIMIT 10")
def _(spark, sf):
    return prep.head_rows(daily(spark, sf)).select("ts")


@query("p12_clip", f"""WITH {IX}, p AS (SELECT a.event_type, a.ts, a.y, b.y * 40 AS yhat FROM ix a JOIN ix b ON a.event_type = b.event_type AND a.idx = b.idx + 1),
  m AS (SELECT event_type, min(y) - 50 AS lo, max(y) + 50 AS hi FROM p GROUP BY 1)
  SELECT event_type, ts, round(greatest(least(yhat, hi), lo), 6) + 0.0 AS yhat FROM p JOIN m USING (event_type)""")
def _(spark, sf):
    d = hourly(spark, sf).over(lambda w: {"yhat": F.lag("y").over(w) * 40}, before=1).where("yhat IS NOT NULL")
    return rounded(prep.clip_to_actuals(d, ["event_type"]).select("event_type", "ts", "yhat"))


@query("p13_standardize", f"""WITH {HOURLY}, m AS (SELECT event_type, avg(y) a, stddev_pop(y) s, avg(cnt) ca, stddev_pop(cnt) cs FROM hourly GROUP BY 1)
  SELECT event_type, ts, round((y - a) / s, 6) + 0.0 AS y_z, round((cnt - ca) / cs, 6) + 0.0 AS cnt_z FROM hourly JOIN m USING (event_type)""")
def _(spark, sf):
    return rounded(prep.standardize(hourly(spark, sf), ["y", "cnt"]).select("event_type", "ts", "y_z", "cnt_z"))


@query("p14_future_frame", f"""WITH {HOURLY}, m AS (SELECT event_type, max(ts) AS last FROM hourly GROUP BY 1)
  SELECT event_type, h::BIGINT AS h, last + h * INTERVAL 1 HOUR AS ts FROM m, range(1, 25) t(h)""")
def _(spark, sf):
    return rounded(prep.future_frame(hourly(spark, sf), 24, 3600))


@query("p15_steps_per_day", f"""WITH {IX}, d AS (SELECT event_type, epoch(ts) - lag(epoch(ts)) OVER ({K}) AS g FROM ix)
  SELECT event_type, min(g) AS step_seconds, greatest(floor(86400 / min(g)), 1)::BIGINT AS steps_per_day FROM d GROUP BY 1""")
def _(spark, sf):
    p = hourly(spark, sf)
    gap = F.unix_seconds(F.col("ts").cast("timestamp"))
    d = p.over(lambda w: {"g": (gap - F.lag(gap).over(w)).cast("double")}, before=1)
    s = d.groupBy("event_type").agg(F.min("g").alias("step_seconds"))
    return s.withColumn("steps_per_day", prep.steps_per_day(F.col("step_seconds")))


@query("g1_shape", "SELECT count(*) AS n_rows, 6::BIGINT AS n_cols FROM events")
def _(spark, sf):
    return profile.shape(table(spark, sf, "events"))


_COLS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@query("g2_column_info", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 2) + 0.0 AS missing_pct, count(DISTINCT {c}) AS unique_count, "
    f"least(count({c}), 3)::BIGINT AS n_samples FROM events" for c in _COLS))
def _(spark, sf):
    d = profile.column_info(raw(spark, sf))
    return rounded(d.select("column", "missing_pct", "unique_count", F.size("sample_values").cast("long").alias("n_samples")), 2)


@query("g3_category_values", """SELECT 'event_type' AS "column", value FROM (SELECT DISTINCT event_type AS value FROM events ORDER BY 1 LIMIT 20)
  UNION ALL SELECT 'props', value FROM (SELECT DISTINCT props AS value FROM events ORDER BY 1 LIMIT 20)""")
def _(spark, sf):
    df = table(spark, sf, "events")
    return profile.category_values(df, profile.column_roles(df)["categorical"])


@query("g4_missing_share", f"WITH {HOURLY} SELECT event_type, round(avg(CASE WHEN cnt > 3 THEN 1.0 ELSE 0 END) * 100, 6) + 0.0 AS missing_pct FROM hourly GROUP BY 1")
def _(spark, sf):
    p = hourly(spark, sf)
    return rounded(profile.missing_share(p.derive(p.df.withColumn("y", F.when(F.col("cnt") <= 3, F.col("y"))))))


@query("g5_outlier_share", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM events GROUP BY 1)
  SELECT event_type, round(avg(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0 END) * 100, 6) + 0.0 AS outlier_pct
  FROM events JOIN q USING (event_type) GROUP BY 1""")
def _(spark, sf):
    return rounded(profile.outlier_share(raw(spark, sf)))


@query("g6_moments", "SELECT event_type, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def _(spark, sf):
    return rounded(profile.moments(raw(spark, sf)))


@query("g7_date_range", "SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def _(spark, sf):
    return profile.date_range(raw(spark, sf))


@query("g8_frequency", f"""WITH {DIX}, d AS (SELECT epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts) AS g FROM ix),
  m AS (SELECT date_trunc('month', ts) AS ts FROM daily GROUP BY 1), md AS (SELECT datediff('month', lag(ts) OVER (ORDER BY ts), ts) AS g FROM m)
  SELECT 'daily' AS series, CASE WHEN min(g) = max(g) THEN min(g) END AS step_seconds, CASE WHEN min(g) = max(g) THEN 'D' END AS frequency FROM d
  UNION ALL SELECT 'monthly', NULL, CASE WHEN min(g) = 1 AND max(g) = 1 THEN 'MS' END FROM md""")
def _(spark, sf):
    p = daily(spark, sf)
    month = p.fresh(p.df.groupBy(F.expr("make_timestamp_ntz(year(ts), month(ts), 1, 0, 0, 0)").alias("ts")).agg(F.sum("y").alias("y")))
    one = lambda q, name: profile.frequency(q).select(F.lit(name).alias("series"), "step_seconds", "frequency")
    return one(p, "daily").unionByName(one(month, "monthly"))


@query("g9_trend", f"WITH {RIX} SELECT event_type, round(regr_slope(y, idx), 8) + 0.0 AS slope, abs(regr_slope(y, idx)) > 0.01 * stddev_pop(y) AS has_trend FROM ix GROUP BY 1")
def _(spark, sf):
    return rounded(profile.trend(raw(spark, sf)), 8)


@query("g10_histogram", """WITH e AS (SELECT event_type, min(value) lo, (max(value) - min(value)) / 50 w FROM events GROUP BY 1),
  c AS (SELECT event_type, least(floor((value - lo) / w), 49)::BIGINT AS bin, count(*) AS c FROM events JOIN e USING (event_type) GROUP BY 1, 2)
  SELECT e.event_type, b::BIGINT AS bin, round(lo + b * w, 6) + 0.0 AS lower, round(lo + (b + 1) * w, 6) + 0.0 AS upper, coalesce(c, 0)::BIGINT AS count
  FROM e CROSS JOIN range(50) t(b) LEFT JOIN c ON c.event_type = e.event_type AND c.bin = b""")
def _(spark, sf):
    return rounded(profile.histogram(raw(spark, sf)))


@query("g11_box", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) q3 FROM events GROUP BY 1),
  x AS (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events JOIN q USING (event_type))
  SELECT event_type, round(min(q1), 6) + 0.0 AS q1, round(min(median), 6) + 0.0 AS median, round(min(q3), 6) + 0.0 AS q3, min(value) FILTER (inside) AS whisker_low,
  max(value) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers FROM x GROUP BY 1""")
def _(spark, sf):
    return rounded(profile.box_statistics(raw(spark, sf)))


@query("g12_warnings", f"""WITH {HOURLY}, m AS (SELECT event_type, avg(CASE WHEN cnt > 3 THEN 1.0 ELSE 0 END) * 100 AS missing_pct FROM hourly GROUP BY 1),
  q AS (SELECT event_type, quantile_cont(y, 0.25) q1, quantile_cont(y, 0.75) q3 FROM hourly WHERE cnt <= 3 GROUP BY 1),
  o AS (SELECT event_type, avg(CASE WHEN y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0 END) * 100 AS outlier_pct FROM hourly JOIN q USING (event_type) WHERE cnt <= 3 GROUP BY 1)
  SELECT event_type, {r('missing_pct', 'outlier_pct')}, (missing_pct > 10)::BIGINT + (outlier_pct > 5)::BIGINT AS n_warnings,
  CASE WHEN missing_pct > 10 OR outlier_pct > 5 THEN 'warning' ELSE 'ok' END AS status FROM m JOIN o USING (event_type)""")
def _(spark, sf):
    p = hourly(spark, sf)
    q = p.derive(p.df.withColumn("y", F.when(F.col("cnt") <= 3, F.col("y"))))
    d = profile.data_warnings(q.attach(profile.missing_share(q), profile.outlier_share(q)))
    return rounded(d.select("event_type", "missing_pct", "outlier_pct", F.size("warnings").alias("n_warnings"), "status"))


@query("g13_profile")
def _(spark, sf):
    return rounded(profile.profile(hourly(spark, sf)).drop("warnings"))


_ACF = f"""WITH {IX}, m AS (SELECT event_type, avg(y) a, min(n) n FROM ix GROUP BY 1), e AS (SELECT ix.event_type, idx, y - a AS e FROM ix JOIN m USING (event_type)),
  v AS (SELECT event_type, sum(e * e) c0 FROM e GROUP BY 1),
  c AS (SELECT a.event_type, l AS lag, sum(a.e * b.e) AS c FROM e a JOIN range(1, 51) t(l) ON true JOIN e b ON a.event_type = b.event_type AND b.idx = a.idx - l GROUP BY 1, 2),
  acf AS (SELECT event_type, m.n, lag::BIGINT AS lag, c / c0 AS acf FROM c JOIN v USING (event_type) JOIN m USING (event_type) WHERE lag <= floor(m.n / 2)
    UNION ALL SELECT event_type, n, 0, 1.0 FROM m)"""


@query("t1_acf", f"{_ACF} SELECT event_type, n, lag, {r('acf')} FROM acf")
def _(spark, sf):
    return rounded(ac.acf(hourly(spark, sf)))


@query("t2_significant_lags", f"{_ACF} SELECT event_type, n, lag, {r('acf')} FROM acf WHERE lag > 0 AND abs(acf) > 2 / sqrt(n)")
def _(spark, sf):
    return rounded(ac.significant_lags(hourly(spark, sf)))


@query("t3_seasonal_period")
def _(spark, sf):
    return decompose.seasonal_period(hourly(spark, sf))


@query("t4_adf")
def _(spark, sf):
    return rounded(stationarity.adf(hourly(spark, sf)))


@query("t4_adf_fixed_lag", f"""WITH {IX}, d AS (SELECT event_type, y - lag(y) OVER ({K}) AS dy, lag(y) OVER ({K}) AS y1 FROM ix),
  g AS (SELECT event_type, count(*) AS m, regr_slope(dy, y1) AS b, regr_intercept(dy, y1) AS a, var_pop(y1) * count(*) AS sxx FROM d WHERE dy IS NOT NULL GROUP BY 1),
  e AS (SELECT event_type, m, b, sxx, sum((dy - a - b * y1) ** 2) AS rss FROM d JOIN g USING (event_type) WHERE dy IS NOT NULL GROUP BY 1, 2, 3, 4)
  SELECT event_type, round(b / sqrt(rss / (m - 2) / sxx), 6) + 0.0 AS adf_statistic, 0::BIGINT AS adf_lags FROM e""")
def _(spark, sf):
    return rounded(stationarity.adf(hourly(spark, sf), 0).select("event_type", "adf_statistic", "adf_lags"))


@query("t4_adf_order", f"""WITH {IX}, d AS (SELECT event_type, idx, y - lag(y) OVER ({K}) AS dy, lag(y) OVER ({K}) AS y1, lag(y) OVER ({K}) - lag(y, 2) OVER ({K}) AS d1 FROM ix),
  s AS (SELECT event_type, count(*) AS m, var_pop(y1) AS yy, var_pop(d1) AS dd, covar_pop(y1, d1) AS yd, covar_pop(y1, dy) AS cy, covar_pop(d1, dy) AS cd, var_pop(dy) AS t FROM d WHERE idx >= 2 GROUP BY 1),
  r AS (SELECT *, yy * dd - yd * yd AS det, (dd * cy - yd * cd) / (yy * dd - yd * yd) AS b, (yy * cd - yd * cy) / (yy * dd - yd * yd) AS c FROM s),
  o AS (SELECT *, t - b * cy - c * cd AS v1, m * ln(t - cy * cy / yy) + 4 <= m * ln(t - b * cy - c * cd) + 6 AS zero FROM r),
  z AS (SELECT event_type, count(*) AS m, var_pop(y1) AS yy, covar_pop(y1, dy) AS cy, var_pop(dy) AS t FROM d WHERE idx >= 1 GROUP BY 1)
  SELECT o.event_type, CASE WHEN zero THEN 0 ELSE 1 END::BIGINT AS adf_lags, round(CASE WHEN zero THEN z.cy / z.yy / sqrt((z.t - z.cy * z.cy / z.yy) / (z.m - 2) / z.yy)
    ELSE b / sqrt(v1 / (o.m - 3) * dd / det) END, 6) + 0.0 AS adf_statistic FROM o JOIN z USING (event_type)""")
def _(spark, sf):
    return rounded(stationarity.adf(hourly(spark, sf), most=1).select("event_type", "adf_lags", "adf_statistic"))


@query("t5_kpss", f"""WITH {IX}, m AS (SELECT event_type, avg(y) a FROM ix GROUP BY 1),
  e AS (SELECT event_type, idx, n, y - a AS e, sum(y - a) OVER (PARTITION BY event_type ORDER BY idx) AS s FROM ix JOIN m USING (event_type)),
  b AS (SELECT event_type, min(n) AS n, sum(e * e) AS c0, sum(s * s) AS eta, floor(4 * pow(min(n) / 100.0, 0.25)) AS lags FROM e GROUP BY 1),
  c AS (SELECT x.event_type, l, sum(x.e * y.e) AS c FROM e x JOIN b USING (event_type) JOIN range(1, 40) t(l) ON l <= lags JOIN e y ON x.event_type = y.event_type AND y.idx = x.idx - l GROUP BY 1, 2),
  w AS (SELECT event_type, sum(2 * (1 - l / (lags + 1.0)) * c) AS w FROM c JOIN b USING (event_type) GROUP BY 1)
  SELECT event_type, lags::BIGINT AS kpss_lags, round((eta / (n * n)) / ((c0 + w) / n), 6) + 0.0 AS kpss_statistic FROM b JOIN w USING (event_type)""")
def _(spark, sf):
    return rounded(stationarity.kpss(hourly(spark, sf), "short").select("event_type", "kpss_lags", "kpss_statistic"))


@query("t5_kpss_auto")
def _(spark, sf):
    return rounded(stationarity.kpss(hourly(spark, sf)))


@query("t6_stl")
def _(spark, sf):
    return rounded(decompose.stl(hourly(spark, sf), 24).select("event_type", "ts", "trend", "seasonal", "resid"))


CLASSICAL = f"""WITH {IX}, t AS (SELECT *, CASE WHEN idx >= 12 AND idx < n - 12 AND n >= 48 THEN
    (sum(y) OVER ({K} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) - 0.5 * (lag(y, 12) OVER ({K}) + lead(y, 12) OVER ({K}))) / 24 END AS trend FROM ix),
  pm AS (SELECT event_type, idx % 24 AS phase, avg(y - trend) AS m FROM t GROUP BY 1, 2), pc AS (SELECT event_type, avg(m) AS c FROM pm GROUP BY 1),
  d AS (SELECT t.*, m - c AS seasonal, y - trend - (m - c) AS resid FROM t JOIN pm ON t.event_type = pm.event_type AND t.idx % 24 = pm.phase JOIN pc ON pc.event_type = t.event_type)"""


@query("t7_classical", f"{CLASSICAL} SELECT event_type, ts, {r('trend', 'seasonal', 'resid')} FROM d")
def _(spark, sf):
    return rounded(decompose.classical(hourly(spark, sf), 24).select("event_type", "ts", "trend", "seasonal", "resid"))


@query("t8_strengths", f"""{CLASSICAL} SELECT event_type, round(greatest(0, 1 - var_samp(resid) / var_samp(trend + resid)), 6) + 0.0 AS trend_strength,
  round(greatest(0, 1 - var_samp(resid) / var_samp(seasonal + resid)), 6) + 0.0 AS seasonal_strength FROM d GROUP BY 1""")
def _(spark, sf):
    return rounded(decompose.strengths(hourly(spark, sf), 24, "classical"))


@query("t8_strengths_stl")
def _(spark, sf):
    return rounded(decompose.strengths(hourly(spark, sf), 24))


_LAGCORR = f"""WITH {IX}, l AS (SELECT a.event_type, t.l AS lag, a.idx, a.n, a.y, b.y AS z FROM ix a JOIN (VALUES (1), (6), (12), (24)) t(l) ON true
    LEFT JOIN ix b ON a.event_type = b.event_type AND b.idx = a.idx - t.l),
  c AS (SELECT event_type, lag::BIGINT AS lag, coalesce(corr(y, z), 0) AS correlation, max(y) FILTER (idx = n - lag) AS value FROM l WHERE n > lag GROUP BY 1, 2)"""


@query("t9_lag_correlations", f"{_LAGCORR} SELECT event_type, lag, {r('correlation', 'value')} FROM c")
def _(spark, sf):
    return rounded(ac.lag_correlations(hourly(spark, sf)))


@query("t10_lag_hints", f"""{_LAGCORR} SELECT * FROM (SELECT event_type, lag, CASE WHEN lag = 1 AND correlation < -0.1 THEN 'mean-reverting' WHEN lag = 1 AND correlation > 0.3 THEN 'persistent'
  WHEN lag = 1 THEN 'weak short-term dependence' WHEN lag IN (12, 24) AND abs(correlation) < 0.1 THEN 'weak seasonality'
  WHEN lag IN (12, 24) AND correlation > 0.3 THEN 'strong seasonal signal' END AS hint FROM c) WHERE hint IS NOT NULL""")
def _(spark, sf):
    return ac.lag_hints(ac.lag_correlations(hourly(spark, sf))).select("event_type", "lag", "hint")


@query("t11_rolling", f"""WITH {RIX} SELECT event_id, round(avg(y) OVER w, 6) + 0.0 AS rolling_mean, round(stddev_samp(y) OVER w, 6) + 0.0 AS rolling_std
  FROM ix WINDOW w AS (PARTITION BY event_type ORDER BY idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return rounded(ac.rolling(raw(spark, sf)).select("event_id", "rolling_mean", "rolling_std"))


@query("t12_lag_matrix", "WITH " + RIX + ", l AS (SELECT event_id, idx, " + ", ".join(f"lag(y, {k}) OVER (PARTITION BY event_type ORDER BY idx) AS lag_{k}" for k in range(1, 7)) +
       " FROM ix) SELECT * FROM l WHERE idx >= 6")
def _(spark, sf):
    return ac.lag_matrix(raw(spark, sf), 6).select("event_id", "idx", *[f"lag_{k}" for k in range(1, 7)])


@query("j1_lags_with_covariates", f"""WITH {IX} SELECT * FROM (SELECT event_type, ts, idx, cnt, users, round(lag(y, 1) OVER ({K}), 6) + 0.0 AS lag_1, round(lag(y, 2) OVER ({K}), 6) + 0.0 AS lag_2 FROM ix) WHERE idx >= 2""")
def _(spark, sf):
    return rounded(ac.lag_matrix(hourly(spark, sf, True), 2).select("event_type", "ts", "idx", "cnt", "users", "lag_1", "lag_2"))


@query("j2_target_feature_matrix", f"WITH {HOURLY} SELECT event_type, ts, round(y, 6) + 0.0 AS x0, cnt AS x1, users AS x2 FROM hourly")
def _(spark, sf):
    p = hourly(spark, sf, True)
    m = p.df.select("event_type", "ts", F.array("y", *p.spec.features).alias("m"))
    return rounded(m.select("event_type", "ts", *[F.get("m", F.lit(i)).alias(f"x{i}") for i in range(3)]))


@query("j5_series_statistics", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type), 6) + 0.0 AS deviation FROM events")
def _(spark, sf):
    p = raw(spark, sf)
    d = p.attach(p.df, p.aggregate(F.avg("value").alias("mean")))
    return rounded(d.select("event_id", (F.col("value") - F.col("mean")).alias("deviation")))


SUMMARY = f"""WITH {IX}, x AS (SELECT *, floor(n * 0.8) AS nt, floor(n * 0.8) - 1 - idx AS back, idx < floor(n * 0.8) AS tr FROM ix),
  a AS (SELECT event_type, count(*) FILTER (tr) AS n_train, count(*) FILTER (NOT tr) AS n_test, avg(y) FILTER (tr) AS train_mean, stddev_samp(y) FILTER (tr) AS train_std,
    min(y) FILTER (tr) AS train_min, max(y) FILTER (tr) AS train_max, avg(y) FILTER (NOT tr) AS test_mean, stddev_samp(y) FILTER (NOT tr) AS test_std,
    avg(y) FILTER (tr AND back < 24) AS d1, avg(y) FILTER (tr AND back >= 24 AND back < 48) AS d2, avg(y) FILTER (tr AND back < 168) AS w FROM x GROUP BY 1)
  SELECT event_type, n_train, n_test, {r('train_mean', 'train_std', 'train_min', 'train_max', 'test_mean', 'test_std')},
    CASE WHEN n_train < 48 THEN 'stable' WHEN d1 > d2 THEN 'upward' ELSE 'downward' END AS recent_trend,
    round(CASE WHEN n_train > 168 THEN w ELSE train_mean END, 6) + 0.0 AS recent_7d_avg, round(CASE WHEN n_train > 24 THEN d1 ELSE train_mean END, 6) + 0.0 AS recent_1d_avg FROM a"""


@query("t13_e1_summary", SUMMARY)
def _(spark, sf):
    return rounded(ac.statistical_summary(hourly(spark, sf)))


@query("t14_context_windows", f"""WITH {RIX} SELECT event_id, count(*) OVER w AS window_size, round(sum(y) OVER w, 6) + 0.0 AS window_sum, first_value(y) OVER w AS window_first, last_value(y) OVER w AS window_last
  FROM ix WINDOW w AS (PARTITION BY event_type ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def _(spark, sf):
    d = ac.context_windows(raw(spark, sf))
    v = F.col("value_window")
    return rounded(d.select("event_id", F.size(v).cast("long").alias("window_size"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("window_sum"),
                            F.get(v, F.lit(0)).alias("window_first"), F.element_at(v, -1).alias("window_last")))


@query("t15_percentile_ranks", f"""WITH {RIX}, p AS (SELECT event_type, idx + 1 AS rank_no, y AS value FROM ix WHERE idx < 5),
  q AS (SELECT event_type, quantile_cont(y, 0.95) AS p95, quantile_cont(y, 0.99) AS p99 FROM ix GROUP BY 1)
  SELECT p.event_type, p.rank_no, p.value, round((count(*) FILTER (ix.y < p.value) + count(*) FILTER (ix.y <= p.value) + CASE WHEN bool_or(ix.y = p.value) THEN 1 ELSE 0 END) * 50.0 / count(*), 6) + 0.0 AS percentile,
    round(min(p95), 6) + 0.0 AS p95, round(min(p99), 6) + 0.0 AS p99 FROM p JOIN ix ON ix.event_type = p.event_type JOIN q ON q.event_type = p.event_type GROUP BY 1, 2, 3""")
def _(spark, sf):
    p = raw(spark, sf)
    first = p.indexed().where("idx < 5").select("event_type", (F.col("idx") + 1).alias("rank_no"), "value")
    return rounded(ac.percentile_ranks(p, first))


@query("k2_channels", f"""WITH {SHIPPED}, v AS (SELECT l_returnflag, 'price' AS channel, var_pop(price) AS variance FROM shipped GROUP BY 1 UNION ALL SELECT l_returnflag, 'discount', var_pop(discount) FROM shipped GROUP BY 1)
  SELECT l_returnflag, channel, round(variance, 6) + 0.0 AS variance, row_number() OVER (PARTITION BY l_returnflag ORDER BY variance DESC, channel) AS rank_no FROM v""")
def _(spark, sf):
    from ..operators.anomaly import channels
    return rounded(channels(shipped(spark, sf)))


@query("k_top_per_series", "SELECT * FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank_no FROM events) WHERE rank_no <= 5")
def _(spark, sf):
    return ranking.top_per_series(raw(spark, sf), 5, "value", "event_id").select("event_type", "event_id", "value", "rank_no")


@query("f1_f4_scalars", f"""WITH {IX}, x AS (SELECT event_type, ts, y, cnt - 2 AS d, lag(y) OVER ({K}) AS p FROM ix)
  SELECT event_type, ts, round(y, 2) + 0.0 AS rounded, round(CASE WHEN d <> 0 THEN y / d END, 6) + 0.0 AS ratio, round(coalesce(p, -1), 6) + 0.0 AS safe,
  round(least(greatest(y, 20), 60), 6) + 0.0 AS clipped, round(sqrt(abs(y - 50)), 6) + 0.0 AS root FROM x""")
def _(spark, sf):
    d = hourly(spark, sf).over(lambda w: {"p": F.lag("y").over(w)}, before=1)
    y = F.col("y")
    bad = F.when(F.col("p").isNull(), F.lit(float("inf"))).otherwise(F.col("p"))
    return rounded(d.select("event_type", "ts", F.round(y + NUDGE, 2).alias("rounded"), guarded_divide(y, F.col("cnt") - 2).alias("ratio"),
                            finite(bad, F.lit(-1.0)).alias("safe"), clip(y, F.lit(20.0), F.lit(60.0)).alias("clipped"), F.sqrt(F.abs(y - 50)).alias("root")))

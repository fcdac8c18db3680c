"""Registered queries: anomaly detection and its explanation, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, clusters, density, explain, isolation_forest, prep, profile
from ..plans.report import facts, report
from ..shared import key_join
from .data import HOURLY, IX, SHIPPED, hourly, kept, query, r, rounded, shipped
from .series import CLASSICAL

FOUR = ["zscore", "mad", "rolling", "iqr"]
SIX = [*FOUR, "stl", "dbscan"]
CLASSIC = {"stl": {"method": "classical"}}
MULTI = [*FOUR, "dbscan"]


def detectors_sql(source: str, part: str, order: str) -> str:
    """CTEs det(..., score_*, flag_*) for the four window/aggregate detectors over ``source``."""
    return f"""
  st AS (SELECT {part}, avg(y) AS mu, stddev_pop(y) AS sd, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS med, quantile_cont(y, 0.75) AS q3 FROM {source} GROUP BY {part}),
  dv AS (SELECT s.*, st.* EXCLUDE ({part}), abs(y - med) AS dev FROM {source} s JOIN st USING ({part})),
  md AS (SELECT {part}, quantile_cont(dev, 0.5) AS mad FROM dv GROUP BY {part}),
  ms AS (SELECT dv.*, mad, CASE WHEN mad = 0 THEN 0 ELSE 0.6745 * dev / mad END AS score_mad FROM dv JOIN md USING ({part})),
  th AS (SELECT {part}, CASE WHEN avg(CASE WHEN score_mad > 3.5 THEN 1.0 ELSE 0 END) > 0.05 THEN greatest(3.5, quantile_cont(score_mad, 0.95)) ELSE 3.5 END AS thr FROM ms GROUP BY {part}),
  rl AS (SELECT ms.*, thr, avg(y) OVER w AS rm, CASE WHEN max(y) OVER w > min(y) OVER w THEN stddev_samp(y) OVER w END AS rs FROM ms JOIN th USING ({part})
    WINDOW w AS (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
  sc AS (SELECT *, CASE WHEN sd = 0 THEN 0 ELSE abs((y - mu) / sd) END AS score_zscore, CASE WHEN rs > 0 THEN abs(y - rm) / (3 * rs) ELSE 0 END AS score_rolling,
    CASE WHEN q3 = q1 THEN 0 ELSE greatest(q1 - 1.5 * (q3 - q1) - y, y - q3 - 1.5 * (q3 - q1), 0) / (q3 - q1) END AS score_iqr,
    y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1) AS flag_iqr FROM rl),
  det AS (SELECT *, score_zscore > 3 AS flag_zscore, score_mad > thr AS flag_mad, score_rolling > 1 AS flag_rolling FROM sc)"""


DET = f"{IX}, {detectors_sql('ix', 'event_type', 'ts')}"
LINE = """z AS (SELECT event_type, ts, y / s AS z FROM ix JOIN (SELECT event_type, CASE WHEN stddev_pop(y) = 0 THEN 1 ELSE stddev_pop(y) END AS s FROM ix GROUP BY 1) USING (event_type)),
  co AS (SELECT a.event_type, a.ts, a.z, count(*) >= 5 AS core FROM z a JOIN z b ON a.event_type = b.event_type AND abs(a.z - b.z) <= 0.5 GROUP BY 1, 2, 3),
  db AS (SELECT a.event_type, a.ts, a.core, NOT bool_or(b.core) AS flag_dbscan FROM co a JOIN co b ON a.event_type = b.event_type AND abs(a.z - b.z) <= 0.5 GROUP BY 1, 2, 3)"""
SIXDET = f"""{CLASSICAL}, {detectors_sql('ix', 'event_type', 'ts')}, {LINE},
  rsd AS (SELECT event_type, stddev_pop(resid) AS rs2 FROM d GROUP BY 1),
  stl AS (SELECT d.event_type, d.ts, coalesce(abs(resid) / rs2 > 3, false) AS flag_stl FROM d JOIN rsd USING (event_type)),
  six AS (SELECT det.*, flag_stl, flag_dbscan, flag_zscore::BIGINT + flag_mad::BIGINT + flag_rolling::BIGINT + flag_iqr::BIGINT + flag_stl::BIGINT + flag_dbscan::BIGINT AS votes
    FROM det JOIN stl USING (event_type, ts) JOIN db USING (event_type, ts))"""


def _voted(spark, sf):
    return kept(spark, sf, "voted", lambda: anomaly.vote(hourly(spark, sf), SIX, 3, CLASSIC))


def _detector(name, **params):
    def run(spark, sf):
        p = hourly(spark, sf)
        d = anomaly.DETECTORS[name](p, p.df, **params)
        return rounded(d.select("event_type", "ts", f"score_{name}", f"flag_{name}"))
    return run


for _name in FOUR:
    query({"zscore": "a1_zscore", "mad": "a2_mad", "rolling": "a3_rolling", "iqr": "a4_iqr"}[_name],
          f"WITH {DET} SELECT event_type, ts, {r('score_' + _name)}, flag_{_name} FROM det")(_detector(_name))
query("a5_stl")(_detector("stl"))
query("a6_isolation_forest")(_detector("iforest"))


@query("a5_classical_residual", f"""{CLASSICAL}, m AS (SELECT event_type, stddev_pop(resid) AS s FROM d GROUP BY 1)
  SELECT event_type, ts, round(coalesce(abs(resid) / s, 0), 6) + 0.0 AS score_stl, coalesce(abs(resid) / s > 3, false) AS flag_stl FROM d JOIN m USING (event_type)""")
def _(spark, sf):
    return _detector("stl", method="classical")(spark, sf)


@query("a2_thresholds", f"WITH {DET} SELECT event_type, round(min(med), 6) + 0.0 AS median, round(min(mad), 6) + 0.0 AS mad, round(min(thr), 6) + 0.0 AS threshold, min(thr) > 3.5 AS adaptive FROM det GROUP BY 1")
def _(spark, sf):
    d = anomaly.mad_statistics(hourly(spark, sf))
    return rounded(d.withColumn("adaptive", F.col("threshold") > 3.5))


@query("a6_multivariate_isolation_forest")
def _(spark, sf):
    p = shipped(spark, sf)
    return rounded(isolation_forest.isolation_forest(p, p.df).select("l_returnflag", "ts", "score_iforest", "flag_iforest"))


@query("a7_dbscan_line", f"WITH {IX}, {LINE} SELECT event_type, ts, flag_dbscan FROM db")
def _(spark, sf):
    p = hourly(spark, sf)
    return density.dbscan(p, p.df).select("event_type", "ts", "flag_dbscan")


@query("a7_dbscan_clusters", f"""WITH {IX}, {LINE}, c AS (SELECT event_type, z, lag(z) OVER (PARTITION BY event_type ORDER BY z) AS p FROM co WHERE core),
  k AS (SELECT event_type, count(*) FILTER (p IS NULL OR z - p > 0.5) AS n_clusters FROM c GROUP BY 1)
  SELECT event_type, count(*) FILTER (core) AS n_core, count(*) FILTER (flag_dbscan) AS n_noise, min(n_clusters) AS n_clusters FROM db JOIN k USING (event_type) GROUP BY 1""")
def _(spark, sf):
    return density.line_summary(hourly(spark, sf), "y")


@query("a7_j4_dbscan_grid", f"""WITH {HOURLY}, s AS (SELECT event_type, stddev_pop(y) a, stddev_pop(cnt) b, stddev_pop(users) c FROM hourly GROUP BY 1),
  z AS (SELECT h.event_type, ts, y / a AS x, cnt / b AS u, users / c AS v FROM hourly h JOIN s USING (event_type)),
  co AS (SELECT p.event_type, p.ts, p.x, p.u, p.v, count(*) >= 5 AS core FROM z p JOIN z q ON p.event_type = q.event_type AND sqrt((p.x - q.x) ** 2 + (p.u - q.u) ** 2 + (p.v - q.v) ** 2) <= 0.3 GROUP BY 1, 2, 3, 4, 5)
  SELECT p.event_type, p.ts, NOT bool_or(q.core) AS flag_dbscan FROM co p JOIN co q ON p.event_type = q.event_type AND sqrt((p.x - q.x) ** 2 + (p.u - q.u) ** 2 + (p.v - q.v) ** 2) <= 0.3 GROUP BY 1, 2""")
def _(spark, sf):
    p = hourly(spark, sf, True)
    return density.dbscan(p, p.df, eps=0.3).select("event_type", "ts", "flag_dbscan")


NEAR = "sqrt((p.x - q.x) ** 2 + (p.u - q.u) ** 2 + (p.v - q.v) ** 2) <= 0.3"


@query("a7_dbscan_grid_clusters", f"""WITH RECURSIVE {HOURLY}, s AS (SELECT event_type, stddev_pop(y) a, stddev_pop(cnt) b, stddev_pop(users) c FROM hourly GROUP BY 1),
  z AS (SELECT h.event_type, ts, y / a AS x, cnt / b AS u, users / c AS v FROM hourly h JOIN s USING (event_type)),
  nb AS (SELECT p.event_type, p.ts, q.ts AS other FROM z p JOIN z q ON p.event_type = q.event_type AND {NEAR}),
  co AS (SELECT event_type, ts, count(*) >= 5 AS core FROM nb GROUP BY 1, 2),
  id AS (SELECT event_type, ts, row_number() OVER (ORDER BY event_type, x, u, v, ts) AS n FROM z JOIN co USING (event_type, ts) WHERE core),
  e AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM nb JOIN id a ON nb.event_type = a.event_type AND nb.ts = a.ts JOIN id b ON nb.event_type = b.event_type AND nb.other = b.ts),
  l(n, c) USING KEY (n) AS (SELECT a, a FROM e GROUP BY 1 UNION
    SELECT e.b, min(l.c) FROM l JOIN e ON l.n = e.a JOIN recurring.l AS r ON r.n = e.b WHERE l.c < r.c GROUP BY 1),
  named AS (SELECT event_type, ts, dense_rank() OVER (PARTITION BY event_type ORDER BY c) - 1 AS k FROM id JOIN l USING (n)),
  own AS (SELECT nb.event_type, nb.ts, min(k) AS touched FROM nb JOIN named ON nb.event_type = named.event_type AND nb.other = named.ts GROUP BY 1, 2)
  SELECT event_type, ts, core, coalesce(k, touched)::BIGINT AS cluster FROM co LEFT JOIN named USING (event_type, ts) LEFT JOIN own USING (event_type, ts)""")
def _(spark, sf):
    p = hourly(spark, sf, True)
    found = clusters.cluster_points(p, eps=0.3)
    return key_join(p.df, found, ["event_type", "y", "cnt", "users"]).select("event_type", "ts", "core", "cluster")


@query("a7_grid_cluster_counts", f"""WITH RECURSIVE {SHIPPED}, s AS (SELECT l_returnflag, stddev_pop(y) a, stddev_pop(price) b FROM shipped GROUP BY 1),
  z AS (SELECT h.l_returnflag AS f, ts, y / a AS x, price / b AS u, 0 AS v FROM shipped h JOIN s USING (l_returnflag)),
  nb AS (SELECT p.f, p.ts, q.ts AS other FROM z p JOIN z q ON p.f = q.f AND {NEAR.replace('0.3', '0.1')}),
  co AS (SELECT f, ts, count(*) >= 5 AS core FROM nb GROUP BY 1, 2),
  id AS (SELECT f, ts, row_number() OVER (ORDER BY f, ts) AS n FROM co WHERE core),
  e AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM nb JOIN id a ON nb.f = a.f AND nb.ts = a.ts JOIN id b ON nb.f = b.f AND nb.other = b.ts),
  l(n, c) USING KEY (n) AS (SELECT a, a FROM e GROUP BY 1 UNION
    SELECT e.b, min(l.c) FROM l JOIN e ON l.n = e.a JOIN recurring.l AS r ON r.n = e.b WHERE l.c < r.c GROUP BY 1),
  noise AS (SELECT nb.f, nb.ts, NOT bool_or(co.core) AS noise FROM nb JOIN co ON nb.f = co.f AND nb.other = co.ts GROUP BY 1, 2)
  SELECT f AS l_returnflag, count(*) FILTER (core) AS n_core, count(*) FILTER (noise) AS n_noise, count(DISTINCT c) AS n_clusters
  FROM co JOIN noise USING (f, ts) LEFT JOIN id USING (f, ts) LEFT JOIN l USING (n) GROUP BY 1""")
def _(spark, sf):
    return clusters.cluster_summary(shipped(spark, sf), ["y", "price"], eps=0.1)


@query("a8_vote", f"WITH {DET} SELECT event_type, ts, round(y, 6) + 0.0 AS y, flag_zscore, flag_mad, flag_rolling, flag_iqr, flag_zscore::BIGINT + flag_mad::BIGINT + flag_rolling::BIGINT + flag_iqr::BIGINT AS votes FROM det "
       "WHERE flag_zscore::INT + flag_mad::INT + flag_rolling::INT + flag_iqr::INT >= 2")
def _(spark, sf):
    d = anomaly.vote(hourly(spark, sf), FOUR, 2).where("is_anomaly")
    return rounded(d.select("event_type", "ts", "y", *[f"flag_{m}" for m in FOUR], "votes"))


@query("a8_vote_six", f"{SIXDET} SELECT event_type, ts, " + ", ".join(f"flag_{m}" for m in SIX) + ", votes, votes >= 3 AS is_anomaly FROM six")
def _(spark, sf):
    return _voted(spark, sf).select("event_type", "ts", *[f"flag_{m}" for m in SIX], "votes", "is_anomaly")


@query("a8_vote_seven")
def _(spark, sf):
    d = anomaly.vote(hourly(spark, sf))
    return d.select("event_type", "ts", *[f"flag_{m}" for m in anomaly.DETECTORS], "votes", "is_anomaly")


@query("a9_u1_multivariate", f"""WITH {SHIPPED}, lg AS (SELECT l_returnflag || '/' || channel AS k, l_returnflag, ts, y FROM (SELECT l_returnflag, ts, unnest(['y', 'price', 'discount']) AS channel, unnest([y, price, discount]) AS y FROM shipped)),
  {detectors_sql('lg', 'k', 'ts')}
  SELECT l_returnflag, ts, bool_or(flag_zscore) AS flag_zscore, bool_or(flag_mad) AS flag_mad, bool_or(flag_rolling) AS flag_rolling, bool_or(flag_iqr) AS flag_iqr,
    bool_or(flag_zscore)::BIGINT + bool_or(flag_mad)::BIGINT + bool_or(flag_rolling)::BIGINT + bool_or(flag_iqr)::BIGINT AS votes FROM det GROUP BY 1, 2""")
def _(spark, sf):
    d = anomaly.vote(shipped(spark, sf), FOUR, 3)
    return d.select("l_returnflag", "ts", *[f"flag_{m}" for m in FOUR], "votes")


@query("a9_multivariate_seven")
def _(spark, sf):
    d = anomaly.vote(shipped(spark, sf))
    return d.select("l_returnflag", "ts", *[f"flag_{m}" for m in anomaly.DETECTORS], "votes", "is_anomaly")


_SUM = f"""{SIXDET}, su AS (SELECT event_type, count(*) AS n_rows, count(*) FILTER (votes >= 3) AS n_anomalies, """ + ", ".join(f"count(*) FILTER (flag_{m}) AS n_{m}" for m in SIX) + """,
  coalesce(avg(votes) FILTER (votes >= 3), 0) AS average_agreement FROM six GROUP BY 1)"""


@query("a10_summary", f"""{_SUM} SELECT *  REPLACE (round(average_agreement, 6) + 0.0 AS average_agreement), round(n_anomalies * 100.0 / n_rows, 6) + 0.0 AS pct_anomalies,
  CASE WHEN n_anomalies = 0 OR n_anomalies * 100.0 / n_rows > 20 THEN 'warning' ELSE 'ok' END AS status FROM su""")
def _(spark, sf):
    return rounded(anomaly.detection_summary(_voted(spark, sf), ["event_type"], SIX).drop("warning"))


@query("n1_k4_zscore_context", f"""{SIXDET}, f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rank_no FROM six WHERE votes >= 3), m AS (SELECT event_type, avg(y) AS mean, stddev_samp(y) + 1e-8 AS std FROM ix GROUP BY 1)
  SELECT event_type, rank_no, ts, round(y, 6) + 0.0 AS value, {r('mean', 'std')}, round((y - mean) / std, 6) + 0.0 AS zscore, round(CASE WHEN mean <> 0 THEN (y - mean) / mean * 100 ELSE 0 END, 6) + 0.0 AS deviation_pct
  FROM f JOIN m USING (event_type) WHERE rank_no <= 5""")
def _(spark, sf):
    return rounded(explain.zscore_context(hourly(spark, sf), _voted(spark, sf)))


@query("n2_iqr_bounds", f"""WITH {IX}, q AS (SELECT event_type, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM ix GROUP BY 1)
  SELECT event_type, {r('q1', 'q3')}, round(q3 - q1, 6) + 0.0 AS iqr, round(q1 - 1.5 * (q3 - q1), 6) + 0.0 AS lower_bound, round(q3 + 1.5 * (q3 - q1), 6) + 0.0 AS upper_bound FROM q""")
def _(spark, sf):
    return rounded(explain.iqr_context(hourly(spark, sf)).drop("expected_range"))


@query("n3_residual_summary", f"""{CLASSICAL} SELECT event_type, round(avg(trend), 6) + 0.0 AS trend_mean, round(max(seasonal) - min(seasonal), 6) + 0.0 AS seasonal_amplitude,
  round(stddev_samp(resid), 6) + 0.0 AS residual_std, round(3 * stddev_samp(resid), 6) + 0.0 AS anomaly_threshold FROM d GROUP BY 1""")
def _(spark, sf):
    from ..operators.decompose import residual_summary
    return rounded(residual_summary(hourly(spark, sf), 24, "classical"))


@query("n3_stl_summary")
def _(spark, sf):
    from ..operators.decompose import residual_summary
    return rounded(residual_summary(hourly(spark, sf), 24))


@query("n4_method_agreement", f"""{_SUM} SELECT event_type, {", ".join("n_" + m for m in SIX)}, round(({" + ".join("n_" + m for m in SIX)}) / 6.0, 6) + 0.0 AS average_agreement, 6::BIGINT AS total_methods FROM su""")
def _(spark, sf):
    return rounded(explain.method_agreement(_voted(spark, sf), ["event_type"], SIX))


@query("n5_percentiles", f"""{SIXDET}, f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rank_no FROM six WHERE votes >= 3), q AS (SELECT event_type, quantile_cont(y, 0.95) AS p95, quantile_cont(y, 0.99) AS p99 FROM ix GROUP BY 1)
  SELECT f.event_type, f.rank_no, round(f.y, 6) + 0.0 AS value, round((count(*) FILTER (ix.y < f.y) + count(*) FILTER (ix.y <= f.y) + 1) * 50.0 / count(*), 6) + 0.0 AS percentile, round(min(p95), 6) + 0.0 AS p95, round(min(p99), 6) + 0.0 AS p99
  FROM f JOIN ix ON ix.event_type = f.event_type JOIN q ON q.event_type = f.event_type WHERE f.rank_no <= 5 GROUP BY f.event_type, f.rank_no, f.y""")
def _(spark, sf):
    d = explain.anomaly_percentiles(hourly(spark, sf), _voted(spark, sf))
    return rounded(d)


@query("n6_snapshots", f"""{SIXDET}, x AS (SELECT *, count(*) OVER w AS window_size, sum(y) OVER w AS window_sum FROM six WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rank_no FROM x WHERE votes >= 3)
  SELECT event_type, rank_no, ts, idx, round(y, 3) + 0.0 AS value, window_size, round(window_sum, 1) + 0.0 AS window_sum FROM f WHERE rank_no <= 10""")
def _(spark, sf):
    d = explain.snapshots(hourly(spark, sf), _voted(spark, sf))
    total = F.aggregate("y_window", F.lit(0.0), lambda a, x: a + x)
    d = d.select("event_type", "rank_no", "ts", "idx", "value", F.size("y_window").cast("long").alias("window_size"), F.round(total, 1).alias("window_sum"))
    return rounded(d, 3)


@query("n7_explained_stl_summary")
def _(spark, sf):
    return rounded(explain.explain_anomalies(hourly(spark, sf), _voted(spark, sf), SIX)["stl"])


_REPORT = f"""{_SUM}, pr AS (SELECT event_type, avg(y) AS mean, stddev_pop(y) AS std, min(y) AS min, max(y) AS max FROM ix GROUP BY 1)
  SELECT 'anomaly' AS section, event_type AS series, '' AS item, unnest(['n_rows', 'n_anomalies', 'average_agreement']) AS metric, unnest([n_rows::DOUBLE, n_anomalies::DOUBLE, round(average_agreement, 6) + 0.0]) AS value FROM su
  UNION ALL SELECT 'profile', event_type, '', unnest(['mean', 'std', 'min', 'max']), unnest([round(mean, 6) + 0.0, round(std, 6) + 0.0, round(min, 6) + 0.0, round(max, 6) + 0.0]) FROM pr"""


@query("r1_report", _REPORT)
def _(spark, sf):
    s = anomaly.detection_summary(_voted(spark, sf), ["event_type"], SIX)
    parts = [facts(s, "anomaly", ["event_type"], None, ["n_rows", "n_anomalies", "average_agreement"]),
             facts(profile.moments(hourly(spark, sf)), "profile", ["event_type"], None, ["mean", "std", "min", "max"])]
    return rounded(report(parts))


@query("y4_analyze_both")
def _(spark, sf):
    from ..plans.analyze import analyze
    from ..spec import AnalysisSpec
    spec = AnalysisSpec(task="both", horizon=12, models=("Naive", "SeasonalNaive"), filters=(("event_type", "!=", "signup"),))
    out = analyze(hourly(spark, sf), spec, {"SeasonalNaive": [{"seasonal_period": 24}]})
    k = ["event_type"]
    return rounded(report([facts(out["final"], "forecast", k, None, ["h", "yhat"]), facts(out["summary"], "anomaly", k, None, ["n_rows", "n_anomalies"])]))

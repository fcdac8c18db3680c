"""Time the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "p9_p10_split", "p13_standardize", "g2_column_info", "g5_outlier_share", "g6_moments", "g9_trend", "g10_histogram",
    "t1_acf", "t4_adf", "t5_kpss_auto", "t6_stl", "t7_classical", "t9_lag_correlations", "t11_rolling", "t12_lag_matrix", "t15_percentile_ranks",
    "m2_seasonal_naive", "m3_arima", "m4_ets", "m5_m12_forest_lags", "v3_fold_metrics", "v7_u2_rolling_origin", "b11_b12_combined_forecast",
    "t3_seasonal_period", "m4_ets_fixed", "m11_network", "m17_train_and_forecast", "a6_isolation_forest", "a7_dbscan_line", "a7_j4_dbscan_grid", "a8_vote", "a9_u1_multivariate", "n5_percentiles", "e5_shapley", "x1_forward",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g")).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from chronopanel.catalog import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

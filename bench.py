"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores. Each query runs
once to warm up and is then timed as the median of three runs into the no-op sink.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from hexcast.plans.queries import QUERIES
from hexcast.session import session

HEADLINE = [
    "hotspots_topn", "risk_full_grid", "syndemic_hotspots", "overview_parent", "viewport_cells", "district_top_cell", "seasonal_mean",
    "weekly_weather", "zonal_mean", "case_lags", "case_rolling", "rain_rolling", "mass_preserving", "kring_mean_1", "gi_star",
    "point_in_polygon", "nearest_centroid", "hotspot_confusion", "lead_time_detection", "regression_metrics", "interval_quantiles",
    "column_profile", "alert_levels", "persistence_runs", "shap_global", "search_districts", "history_last12",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

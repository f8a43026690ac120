"""Times the headline queries on one machine and prints one JSON line.

Each query runs once to warm up, then ``BENCH_RUNS`` times (default 3); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tauframe.plans import catalog  # noqa: E402
from tauframe.session import build_session  # noqa: E402

HEADLINE = [
    "frame_index", "transition_counts", "tpm_lag", "lag_sweep_counts", "tpm_series",
    "tpm_series_mle", "memory_kernel", "memory_prediction", "rmse_sweep", "mean_first_passage",
    "implied_timescales", "bootstrap_timescales", "rayleigh_scores", "macrostate_series",
    "sampled_states", "pair_distances", "covariance_matrices", "tica_projection",
    "feature_selection", "k_centers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        # tables of a few MB: let AQE keep partitions small enough to use every core
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64kb", "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.log.level": "ERROR"})
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        run = catalog.queries()[name]
        seen = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seen.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seen[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 4),
                      "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

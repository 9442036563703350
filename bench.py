"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: input folder (default sf0.1). BENCH_CPUS: local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tapeworks.plans import catalog, registry
from tapeworks.session import local_session

HEADLINE = [
    "net_pnl_by_instrument", "v2_reject_counts", "d1_dedup_fills", "a1_signed_positions", "a5_equity_curve",
    "a6_drawdown_summary", "a9_fifo_match", "r11_correlation_matrix", "r14_bootstrap_sharpe", "f1_bars_5m",
    "f5_f6_momentum", "f13_f14_f15_regime", "p1_features_as_of", "p4_pit_join", "x3_decision_stats",
    "t1_arrival_join", "t3_t4_tca_summary", "t9_execution_schedule", "m3_training_set", "n3_n4_sentiment",
    "w2_information_coefficient", "w8_parameter_sweep", "q1_latency_bad_ratio", "q6_latency_quantiles",
    "s3_stream_positions",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["q6_rates"](spark, sf).write.format("noop").mode("overwrite").save()  # start-up
    times = {}
    for name in HEADLINE:
        registry.forget_shared()  # every query pays for its own intermediate tables
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

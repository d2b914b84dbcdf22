"""Headline queries at one scale factor; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the input and cores.
Each query runs to completion into the no-op sink. Queries that evaluate a stored windows table
include the time to build and store it the first time it is needed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "window_forecast", "session_spine", "window_labels", "episodes", "targets", "feat_volume", "feat_hosts_ports",
    "feat_entropy", "feat_new_pairs", "feat_new_ports", "feat_sequential_ports", "feat_beacon", "network_states",
    "split_p1", "scaler_fit", "binner_fit", "next_state_nll", "avg_precision", "block_bootstrap",
    "conformal_threshold", "adaptive_threshold", "sustained_policy", "two_level_alert", "lead_time",
    "transition_table", "rollout_risk", "next_stage_blend", "group_counterfactual", "host_attribution",
    "countermeasures", "snippets", "campaign_injection", "read_flowmeter", "packet_statistics",
    "logistic_scores", "stream_states",
)


def main() -> None:
    from checks.catalog import QUERIES
    from netloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:] or HEADLINE
    times = {}
    for name in only:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "netloom headline queries, total wall time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

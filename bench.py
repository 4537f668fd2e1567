"""Headline queries at one scale factor; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores), BENCH_QUERIES (comma list).
Times are warm: every query runs once before it is measured, and each run recomputes everything.
"""

from __future__ import annotations

import json
import os
import time

from tracelake.catalog import QUERIES
from tracelake.session import build_session

HEADLINE = (
    "clean_dedupe", "case_ids_dense", "outcome_presence", "ingest_stats", "case_features", "features_at_t", "cycle_time", "vocab", "prefixes_left",
    "prefixes_right", "encode_stats", "transitions", "transition_stats", "feedback_transitions", "split_random", "split_temporal", "split_profile",
    "continuity_gaps", "q_table", "greedy_policy", "fitted_q", "behavior_policy", "ope_policies", "ope_bootstrap", "ope_bootstrap_poisson", "ope_temperature",
    "occlusion", "top_tokens_global", "q_drop", "action_flip", "prototypes", "distill_sample", "tree_rules", "apply_rules", "surrogate_fidelity",
    "guard_decisions", "daily_metrics", "psi", "ks", "drift_signals", "stream_daily_metrics", "stream_decisions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(os.cpu_count() if cpus == "*" else cpus), spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cotflow.plans import inputs  # noqa: E402
from cotflow.plans.catalog import QUERIES  # noqa: E402
from cotflow.session import local_session  # noqa: E402

HEADLINE = [
    "accuracy",
    "normalize_number",
    "extract_graph",
    "assemble_results",
    "check_contracts",
    "value_dependency_edges",
    "complexity_estimate",
    "enumerate_orderings",
    "sample_orderings",
    "reasoning_paths_cots",
    "reasoning_paths_full",
    "step_flexibility",
    "analysis_summary",
    "cap_paths",
    "alternative_cots",
    "keep_last",
    "sample_n",
    "train_val_split",
    "id_differences",
    "supporting_context",
    "explode_calls",
    "ingest_responses_stream",
]
# From here on the queries read the stored paths.
FIRST_REPORT = "step_flexibility"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench", **{"spark.sql.shuffle.partitions": cores})
    # Start-up and class loading are not part of any query.
    QUERIES["split_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        if name == FIRST_REPORT:
            start = time.perf_counter()
            inputs.paths(spark, sf_dir)
            seconds["store_paths"] = round(time.perf_counter() - start, 3)
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    line = {
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()

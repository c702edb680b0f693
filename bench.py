"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugework.plans import catalog  # noqa: E402
from gaugework.session import local_session  # noqa: E402

HEADLINE = (
    "exact_match_scores",
    "normalized_match_scores",
    "metric_summary",
    "slice_summary",
    "aggregate_comparison",
    "gate_results",
    "gate_cases",
    "change_counts",
    "score_distribution",
    "operational_distribution",
    "quantile_summary",
    "read_cases",
    "write_cases",
    "publication_audit",
    "sql_text_audit",
    "result_set_equivalent",
    "result_set_scores",
    "table_fingerprint",
    "first_occurrence",
    "attempt_gaps",
    "newest_first",
    "suite_target_pairs",
    "lifecycle_violations",
    "idempotency_conflicts",
    "duration_histogram",
    "trace_rollup",
    "keyset_page",
    "request_metrics_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    chosen = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

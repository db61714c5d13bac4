"""Headline queries, timed one after the other. Prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pacemark.plans import catalog  # noqa: E402
from pacemark.session import local_session  # noqa: E402

HEADLINES = [
    "pairs_first_resolution", "pairs_linked", "pairs_cleaned", "merge_keep_first", "quota_per_repo",
    "document_text_features", "page_text_features", "complexity_score", "duration_stats", "repo_breakdown",
    "file_history", "cochange_edges", "history_features", "regression_metrics", "sa_random_exact",
    "model_comparison", "error_by_range", "best_worst_examples", "sensitivity_analysis", "stream_ingest",
    "train_eval_abc", "batch_score",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, int(cores), "pacemark-bench")
    plans = catalog.queries()
    # the first query of a session pays for class loading and code generation
    plans["repo_shares"](spark, folder).collect()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        plans[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

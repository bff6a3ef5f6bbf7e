"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from sparkmeter.plans import registry
from sparkmeter.session import local_session

HEADLINE = [
    "conversation_receipts", "conversation_keywords", "conversation_metrics", "reasked_prompts", "public_topics", "ledger_summary", "duplicate_requests",
    "session_audit", "corpus_floor", "session_measures", "context_decomposition", "input_concentration", "before_after_summary", "task_scoped_context", "whatif_sweep",
    "context_bound", "bound_sensitivity", "policy_replay", "content_words", "log_calls", "metered_replies",
]


def main(names):
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    registry.load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    took = {}
    for name in names or HEADLINE:
        t = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main(sys.argv[1:])

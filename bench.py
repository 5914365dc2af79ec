"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "utterances",
    "diarized_utterances",
    "transcript_markdown",
    "punctuation_glue",
    "normalized_documents",
    "document_error_rates",
    "clip_alignment",
    "recording_sessions",
    "gated_echo_report",
    "echo_scores",
    "queue_row_states",
    "retention_plan",
    "state_from_changes",
    "consent_verdicts",
    "run_means",
    "pareto_front_events",
    "retained_lines",
    "recent_logs",
]


def main() -> None:
    from parley.catalog import QUERIES
    from parley.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else None)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["run_means"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM
    took: dict[str, float] = {}
    for name in HEADLINE:
        # The first run pays for class loading and code generation.
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(min(runs), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    line = {"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}
    print(json.dumps(line))


if __name__ == "__main__":
    main()

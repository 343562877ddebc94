"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_QUERIES an optional comma list.
Each query is built and fully materialised twice after a short warm-up of the session: `queries` and `value` are of the
first, cold run, `warm` of the second; `rows_per_sec` relates the warm run to the rows of the table that the query reads.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from scanmill.plans import load
from scanmill.session import get_session

HEADLINE = [
    # scan log analytics
    "overview_stats", "document_type_stats", "daily_trends", "processing_metrics", "percentiles_rank", "percentiles_rank_by_type",
    "api_usage_daily", "load_test_metrics", "usage_metrics", "batch_job_stats", "batch_progress",
    # windows and joins
    "running_average", "failed_attempts_15m", "sliding_rate_count", "failure_streaks", "cooccurring_keys", "webhook_fanout",
    "hamming_duplicates", "exact_duplicates",
    # text
    "text_features", "classify_cascade", "merge_classifications", "detect_processor_priority", "extract_fields", "detect_global_types",
    "nationality_code", "fraud_scoring", "injection_flags", "image_metric_score",
    # memory and streams
    "search_memories", "conversation_summary", "stream_type_stats", "stream_api_usage", "rate_limiter_stream", "session_usage",
    # every pack, completeness, training
    "extract_fields_by_pack", "extraction_confidence", "train_random_forest",
]
# Queries whose throughput is reported, by the table they read row by row.
TEXTS = ("text_features", "classify_cascade", "merge_classifications", "detect_processor_priority", "extract_fields", "extract_fields_by_pack",
         "extraction_confidence", "detect_global_types", "nationality_code", "fraud_scoring", "injection_flags")
EVENTS = ("stream_type_stats", "stream_api_usage", "rate_limiter_stream", "session_usage")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    # Only the result line goes to standard output.
    with contextlib.redirect_stdout(sys.stderr):
        spark = get_session(f"local[{cpus}]", "bench", **{"spark.ui.showConsoleProgress": "false"})
        queries, _ = load()
        queries["manager_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times: dict[str, float] = {}
        warm: dict[str, float] = {}
        for n in names:
            for run in (times, warm):
                start = time.perf_counter()
                queries[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
                run[n] = round(time.perf_counter() - start, 3)
            print(n, times[n], warm[n], file=sys.stderr)
        rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "customer", "events")}
        per = {n: round((rows["documents"] + rows["customer"]) / warm[n]) for n in TEXTS if n in warm} | {n: round(rows["events"] / warm[n]) for n in EVENTS if n in warm}
        spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "warm": warm, "rows_per_sec": per, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()

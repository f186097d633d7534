"""Times the headline queries and prints one JSON line.

Every query is run to the end without keeping its rows: once to warm up, then timed. ``BENCH_REPEATS`` (1) timed runs
are taken and their median reported.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from docsieve.plans.registry import all_queries
from docsieve.session import local_session

HEADLINES = (
    "b1_clean_text",
    "b9_find_with_context",
    "b13_ngrams",
    "c4_span_statistics",
    "c7_top_words",
    "d1_side_tfidf",
    "d2_significant_terms",
    "d4_match_phrases",
    "d15_entity_mismatches",
    "e3_predict_category",
    "f1_extract_employment",
    "f5_employment_gaps",
    "g5_turnover_score",
    "h8_binary_report",
    "i1_analyze",
    "j5_run_status",
    "j9_stream_runs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> float:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds = {}
    for name in HEADLINES:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
    total = round(sum(seconds.values()), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

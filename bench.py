"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3; the median counts, after one warm-up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from caseframe.plans import catalog  # noqa: E402
from caseframe.session import local_session  # noqa: E402

HEADLINE = (
    "timeline_macb",
    "timeline_top_n",
    "known_match",
    "nsrl_match",
    "syslog_parse",
    "infer_years",
    "log_resolve_time",
    "supertimeline",
    "search_literal",
    "search_regex",
    "search_chunked",
    "search_ioc_table",
    "search_all_arms",
    "block_overlap",
    "recovery_tier",
    "content_digests",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=cpus)
    queries = catalog.queries()
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeat + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    result = {
        "metric": "evidence_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()

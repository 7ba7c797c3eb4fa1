"""Time the headline queries: median of three runs after one warm-up, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from obscat.plans import QUERIES
from obscat.session import local_session

HEADLINE = (
    "obs_fold", "late_rejected", "golden_record", "rank_observations", "merge_duplicates",
    "search_many_titles", "search_topk", "enrich_list_detail", "fact_merge", "fact_suffix",
    "override_apply", "refresh_rollup", "title_attributes", "page_links", "page_facts",
    "json_release_flatten",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            spark.catalog.clearCache()
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    total = round(sum(times.values()), 3)
    line = {
        "metric": "headline_query_seconds", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries from the raw tables; prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names (default: the list below)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from catalog import all_queries  # noqa: E402
from catalog.registry import forget_views  # noqa: E402
from millrace.session import build_session  # noqa: E402

HEADLINE = (
    "topic_timeline",
    "genre_interest",
    "topic_preferences",
    "source_preferences",
    "effective_interest",
    "interest_clusters",
    "neighbor_similarity",
    "novelty",
    "feed_slots",
    "feed_slots_capped",
    "related_articles_capped",
    "vector_topk",
    "title_matches",
    "vector_matches",
    "dedup_decisions",
    "url_lines",
    "normalize_url",
    "source_classes",
    "feed_entries",
    "crawl_enqueued",
    "feed_counters",
    "page_ingest",
    "rank_correlation_capped",
    "throttle",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="20g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # A query outside the list, with Python workers, starts the JVM's and the workers' caches.
    queries["page_titles"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        forget_views()  # every query starts from the raw tables
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores, ``BENCH_RUNS``
the timed runs per query (the median counts, after one warm-up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import QUERIES  # noqa: E402
from presslens.session import local_session  # noqa: E402

HEADLINE = [
    "score_articles", "score_articles_joined", "kpi_strip", "label_distribution",
    "sentiment_by_source", "top_headlines_both", "term_frequency", "load_articles",
    "extract_articles", "doc_keywords", "doc_summary", "insert_new", "insert_counts",
    "score_unscored", "feed_items", "sitemap_urls", "discover_all", "dedupe_keep_first",
    "word_text_by_source", "csv_roundtrip", "run_summary",
]


def timed(spark, query, sf_dir: str) -> float:
    """Seconds to compute every column of every row, without moving rows here."""
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "presslens-bench")
    seconds = {}
    for name in names:
        timed(spark, QUERIES[name], sf_dir)
        seconds[name] = round(
            statistics.median(timed(spark, QUERIES[name], sf_dir) for _ in range(runs)), 3
        )
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

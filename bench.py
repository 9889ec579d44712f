"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Every result is computed in full: each query is written to Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mediaseries.plans.queries import QUERIES  # noqa: E402
from mediaseries.session import build_session, staging  # noqa: E402

HEADLINE = (
    "daily_info",
    "daily_sentiment",
    "tlcc_pearson",
    "tlcc_spearman",
    "tlcc_kendall",
    "wtlcc_sentiment",
    "media_summary",
    "user_metrics",
    "user_metric_boxes",
    "format_datetimes",
    "word_counts",
    "merge_upsert_text",
    "merge_upsert_id",
    "classify_lexicon",
    "classify_model",
    "page_articles",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "bench", int(cpus) if cpus.isdigit() else 8)
    QUERIES["daily_info"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is no part of any query
    seconds = {}
    for name in names:
        start = time.perf_counter()
        with staging(spark):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    if "classify_lexicon" in seconds:
        line["classified_texts_per_sec"] = round(texts / seconds["classify_lexicon"], 1)
    print(json.dumps(line))


if __name__ == "__main__":
    main()

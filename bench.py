"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
local cores. Each query is planned and run to the end once after a short warm-up; rows go to
the no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "exact_counts",
    "byte_windows",
    "top_grams",
    "normal_vocabulary",
    "screen_verdicts",
    "run_counters",
    "find_passages",
    "filter_generations",
    "training_curve",
    "bloom_members",
    "bloom_audit",
    "signed_frequency_sketch",
    "frame_headers",
    "stream_numbers",
    "flow_buffers",
    "http_heads",
    "streamed_counts",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bytesieve-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from bytesieve.functions.codec import windows
    from bytesieve.operators.counts import count_grams
    from bytesieve.plans.inputs import payloads
    from bytesieve.plans.registry import QUERIES
    import bytesieve.plans.gram_queries  # noqa: F401
    import bytesieve.plans.packet_queries  # noqa: F401
    import bytesieve.plans.source_queries  # noqa: F401

    queries = {name: QUERIES[name] for name in HEADLINE}
    queries["count_all_windows"] = lambda s, d: count_grams(payloads(s, d), 5)
    queries["count_100_windows"] = lambda s, d: count_grams(payloads(s, d), 5, max_wins=100)
    chosen = sys.argv[1:] or list(queries)

    windows(payloads(spark, sf_dir).limit(100), 5).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Times the headline queries, warm, and prints one JSON line.

Each query runs twice to warm up and then three times; the median counts. The
result is written to Spark's ``noop`` sink, so the whole answer is computed.
``value`` is the sum over the five questions; ``queries`` has every timing.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reviewloom import workload  # noqa: E402
from reviewloom.session import build_session  # noqa: E402

QUESTIONS = ["platform_counts", "top_playtime", "top_reviewed", "over_threshold", "percentile_cut"]
OPERATORS = [
    "all_answers", "over_threshold_marker", "over_threshold_profile", "percentile_keep", "percentile_linear",
    "count_join_union", "join_concat_names", "route_counts", "clean_reviews", "csv_reviews",
    "chunk_head", "union_partitions", "compare_ordered", "compare_unordered", "lang_marker",
    "lang_profile", "lang_classify", "first_delivery", "missing_batches", "stream_counts",
    "stream_top", "stream_question_top", "tenant_percentile",
]
WARMUPS = 2
RUNS = 3


def measure(spark, run, sf_dir):
    times = []
    for _ in range(WARMUPS + RUNS):
        began = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    return round(statistics.median(times[WARMUPS:]), 3)


def main(names):
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = workload.queries()
    timings = {name: measure(spark, queries[name], sf_dir) for name in names}
    print(json.dumps({
        "metric": "five questions, warm median of 3",
        "value": round(sum(timings.get(name, 0) for name in QUESTIONS), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or QUESTIONS + OPERATORS)

"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores.
Each query runs once unmeasured at the same size, since a fresh JVM spends longer
on compiling than on the data, and then once measured to a full write-out.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexitilt.plans.queries import QUERIES  # noqa: E402
from lexitilt.session import local_session  # noqa: E402

HEADLINE = [
    "lexicon_bias", "lexicon_variants", "scope_decisions", "seniority_labels", "dedup_flags",
    "seniority_hybrid", "model_text", "capped_dedup", "vocabulary", "top_words", "join_coverage",
    "length_quantiles", "ppmi_vectors", "dense_vectors", "weat_exact", "weat_ppmi", "ppmi_neighbours",
    "weat_seeds", "weat_summary", "weat_variant_compare", "weat_interpretation",
]


def run(spark, folder, name):
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, folder, name)
        seconds[name] = round(run(spark, folder, name), 3)
    print(json.dumps({"metric": "headline queries, total time",
                      "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

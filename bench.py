"""Bench: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected).  Every query runs twice; ``queries`` holds the better of
the two runs (JIT-warm), ``cold`` the first run.  Prints one JSON line.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from choicekit.plans.registry import queries  # noqa: E402
from choicekit.session import local_session  # noqa: E402

HEADLINE = [
    "build_dataset",          # L2: merge, split, binarise, union, partitioned write
    "enrich_concepts",        # L1: n-grams, encode, similarity, translate, knowledge
    "evaluate_predictions",   # L3: softmax/argmax/accuracy/CE/BCE by split
    "link_concepts",          # L4: one-hop / two-hop graph linking
    "ngrams_1_2",
    "vocab_encode",
    "dictionary_translate",
    "topk_similar",
    "cosine_kmeans_grouped",
    "entity_best_match",
    "segment_split",
    "csv_round_trip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)),
                          app="choicekit-bench")
    qs = queries()
    # warm-up: JVM, codegen caches, parquet footers
    qs["split_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - t0, 3))
        cold[name], times[name] = runs[0], min(runs)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "stat": "best of 2",
                      "cold": cold, "cold_total": round(sum(cold.values()), 3)}))


if __name__ == "__main__":
    main()

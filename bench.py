"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from variform.plans.catalogue import QUERIES
from variform.session import local_session

HEADLINE = (
    "prepared_features",
    "dist_nan_euclidean",
    "dist_row_sum",
    "dist_pair_lookup",
    "sample_maxsum",
    "sample_maxmin",
    "sample_maxmin_categorical",
    "sample_genus",
    "metric_fvo",
    "sweep_results",
    "group_overlap_family",
    "neighbour_group_purity",
    "geo_distances",
    "selected_units",
    "avg_tokens",
    "token_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    # start the JVM and the Python workers outside the timings
    spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").mapInArrow(lambda batches: batches, "p_partkey long").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    rates = {
        "row_sum_pairs_per_sec": round(n * n / seconds["dist_row_sum"]),
        "sec_per_maxsum_pick": round(seconds["sample_maxsum"] / 10, 3),
        "sec_per_maxmin_pick": round(seconds["sample_maxmin"] / 10, 3),
    }
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))[2:], "rates": rates}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

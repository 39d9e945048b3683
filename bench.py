"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from assay import analyze
from assay.catalog.registry import REGISTRY
from assay.session import local_session

HEADLINE = (
    "profile_lineitem", "profile_part_text", "profile_labelled", "approximate_profile", "value_frequencies", "sample_values",
    "missing_values", "missing_cluster", "missing_time_regime", "co_missing", "duplicate_rows", "conflicting_ids",
    "class_imbalance", "outlier_statistics", "association_lineitem", "association_regression", "mutual_information",
    "correlation_matrix", "correlation_matrix_by_products", "usage_totals", "over_limit_attempts", "anonymized_events",
    "fill_median", "fill_median_by_year", "drop_duplicates", "majority_labels", "stratified_split_counts", "class_weights",
    "group_split_keys", "winsorized", "rare_levels_grouped", "overall_scores",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "assay-bench")
    spark.sparkContext.setLogLevel("OFF")
    run(spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count())  # start-up
    times: dict[str, float] = {}
    for key in HEADLINE:
        start = time.perf_counter()
        run(REGISTRY[key].run(spark, folder))
        times[key] = round(time.perf_counter() - start, 3)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    start = time.perf_counter()
    run(analyze(lines, "lineitem", "l_returnflag").scores)
    times["analyze_lineitem"] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    rows = lines.count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "analyze_rows_per_second": round(rows / times["analyze_lineitem"]),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the local cores.
Every query runs in full; its result goes to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "n1_recipe_apply",
    "c1_drop_duplicates",
    "c2_sort_rows",
    "c4_delete_rows_gt",
    "c9_remove_outliers_iqr",
    "d4_derive_column",
    "d6_fill_missing_median",
    "d7_replace_in_pages",
    "d13_encode_label",
    "e1_extract_date_part",
    "f6_z_score_scaling",
    "f7_robust_scaling",
    "g2_equal_frequency",
    "h1_shift_column",
    "h3_rolling_window_stats_nested",
    "h5_stats_percentile_rank",
    "h6_fill_forward",
    "i1_group_aggregate",
    "i2_rollup_by_dimensions",
    "i6_hierarchical_rollup",
    "j1_join_large",
    "j3_diff",
    "a10_upsert_by_row_index",
    "b1_infer_schema",
    "k1_k2_overview",
    "k4_numeric_summary",
    "k5_correlations",
    "l15_regression_metrics",
    "l1_linear_regression",
    "l7_knn_classifier",
    "m1_chunk_text",
    "m3_vector_search",
]


def main() -> None:
    from rowloom import build_session
    from rowloom.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}))


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores  (default 8)
    BENCH_QUERIES  comma-separated names, or 'all'
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "f2_scenario_scores", "f4_benchmark_means", "f5_factor_scores", "f6_missing_counts",
    "f10_describe", "f20_difficulty_spread", "f25_factor_summary",
    "d3_fill_median", "g2_balanced_items", "g3_balanced_by_factor", "g4_blueprint_selection",
    "g13_row_numbers", "i1_undersample", "i2_exact_split", "i3_covering_split",
    "j1_pearson_matrix", "e10_pairwise_statistics", "j2_spearman_matrix", "j19_cronbach_alpha",
    "j20_fit_indices", "j21_auc", "j21_auc_model", "j22_auc_by_scenario", "j23_ctt_correlation",
    "c14_correlated_items", "j7_item_components", "j14_item_vectors", "j15_rank_sweep",
    "j11_varimax", "j24_kmeans", "j27_factor_counts", "k1_taker_abilities",
    "k2_confirmatory_evaluation", "k4_exploratory_items", "k7_penalised_abilities",
    "k9_text_regression_evaluation", "l2_item_skills",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from itemspark.catalog import QUERIES
    from itemspark.session import drop_staged_tables
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = (list(QUERIES) if wanted == "all" else [w for w in wanted.split(",") if w] or HEADLINE)
    QUERIES["f2_scenario_scores"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        drop_staged_tables(spark)
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{times[name]:8.2f} {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")),
                      "cpus": cpus}))


if __name__ == "__main__":
    main()

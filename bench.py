"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lattica.plans.queries import QUERIES

HEADLINE = [
    "describe_by", "quantile_types", "correlation_pearson", "correlation_spearman", "t_test_welch", "chisq_independence", "wilcoxon_rank_sum", "anova_oneway", "anova_two_way",
    "linear_model", "ridge_regression", "logistic_regression", "poisson_regression", "survival_curve", "log_rank_test", "cox_regression", "autocorrelation", "arima_batch",
    "principal_components", "mvn_estimation", "multiple_imputation", "bootstrap_mean", "permutation", "multinomial_regression", "ordinal_regression", "mixed_model", "additive_model",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["describe_by"](spark, sf_dir).collect()  # starts the engine
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).collect()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query runs once to
warm up and is then timed over building, planning and a full run into a sink that
discards the rows.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "p4_filter_in",
    "p8_recode",
    "p15_incidence_rate",
    "p18_replace_outliers",
    "r2_pivot",
    "j1_join_inner",
    "j2_join_full_outer",
    "e2_distinct",
    "a1_sum_by",
    "a2_panel_rollup",
    "a8_summary_tables",
    "w4_rolling_mean",
    "w5_group_total",
    "w6_lag_expand",
    "c2_quantile_class",
    "c3_map_table",
    "i2_lagged_corr",
    "i5_coef_table",
    "i8_regional_ols",
    "i10_poisson_glm",
    "t4_decompose",
    "t5_acf",
    "t8_adf_statistic",
    "t10_arx_forecast",
    "t11_prediction_intervals",
    "t15_residual_histogram",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from panelspark.plans import registry
    from panelspark.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    times: dict[str, float] = {}
    for name in HEADLINE:
        fn = registry.QUERIES[name]
        run(fn(spark, sf_dir))
        start = time.perf_counter()
        run(fn(spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

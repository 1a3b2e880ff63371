"""Bench: run the headline queries on $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS]
and print ONE JSON line. Each query is forced to completion with the ``noop`` sink, so
the whole plan runs without collecting rows to the driver."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship", "build_features", "rank_first", "decile_table", "evaluate", "drift_table", "psi_quantile",
    "ks_two_sample", "univariate_auc", "group_stats", "describe_numeric", "campaign_grid", "campaign_capacity",
    "frequent_itemsets", "association_rules", "rule_collapse", "components", "quantiles",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from strata.plans.registry import queries
    from strata.session import checkpoint_dir, local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="strata-bench")
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    qs = queries()
    names = [n for n in (os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE) if n in qs]
    # warm-up: JVM, parquet footers, codegen caches
    qs["scan_table"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    try:
        sf_val = float(sf)
    except ValueError:
        sf_val = sf
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_val}))


if __name__ == "__main__":
    main()

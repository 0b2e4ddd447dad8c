"""Time the headline queries: prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quotaloom.plans import catalog  # noqa: E402
from quotaloom.session import build_session  # noqa: E402

HEADLINE = (
    "concern_cutoffs", "entity_rollup", "omission_metrics", "route_queue", "workload_grid", "fixed_workload_grid",
    "decision_baselines", "select_signal", "residual_triage", "regression_metrics", "risk_coverage", "score_summary",
    "conformal_intervals", "group_conformal", "split_three_way", "split_random", "star_assembly", "gate_accepted",
    "case_panel", "fill_cascade", "dedupe_exact", "duplicate_audit", "effect_values", "html_anchors",
    "hashed_fingerprints", "knn_mean", "knn_group_minimum", "tanimoto_novelty", "gower_knn", "taxonomy_novelty",
    "local_outlier_factor", "cluster_bootstrap", "paired_bootstrap",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "quotaloom-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # JVM warm-up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query result is written to Spark's ``noop`` sink, which computes every
column of every row (``count()`` could prune columns away). One JSON line is
printed: total seconds, per-query seconds, rows and tickets per second.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sevscope.plans.queries import REGISTRY  # noqa: E402
from sevscope.session import clear_staged, local_session  # noqa: E402

HEADLINE = (
    "fuse_documented",      # full audit: prep, 3 signals, fusion, percentile cuts, gate
    "fuse_train",
    "fuse_notebook",
    "document_rule_signal", # rule signal over whole multilingual documents
    "dossiers",             # evidence records for every flagged ticket
    "dashboard_kpis",
    "delta_heatmap",
    "signal_agreement",
    "ablation",
    "signal_summary",
    "stratified_split",
    "score_fixed",          # streaming, fixed rules
    "score_frozen",         # streaming, frozen batch model
    "kmeans_clusters",
    "score_classifier",     # Spark ML: features, weighted LR, score every ticket
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, shuffle_partitions=max(8, cpus))
    # warm-up on the smallest data (JIT, class loading); not timed
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        REGISTRY["fuse_documented"](spark, warm).write.format("noop").mode("overwrite").save()

    times = {}
    for name in names:
        t0 = time.perf_counter()
        df = REGISTRY[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        clear_staged(spark)  # the query's staged tables
    n_tickets = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    total = round(sum(times.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    fused = times.get("fuse_documented")
    scored = times.get("score_classifier")
    print(json.dumps({
        "metric": "headline_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "tickets": n_tickets,
        "tickets_per_sec_audit": round(n_tickets / fused, 1) if fused else None,
        "tickets_per_sec_classifier": round(n_tickets / scored, 1) if scored else None,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()

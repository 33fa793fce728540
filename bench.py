"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]
and print one JSON line with per-query wall-clock seconds.

Each query is executed in full with the ``noop`` sink (every row is produced,
nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans import catalog  # noqa: E402
from tessera.session import local_session  # noqa: E402

HEADLINE = [
    "clean_orders_summary",
    "clean_policy_delivery",
    "corrupt_domain_sales",
    "enr_all_for_domain_pm",
    "lf_apply_domain_pm",
    "dq_overall",
    "persona_alignment",
    "parse_cleaning_action",
    "traj_episode_metrics",
    "sft_step_examples",
    "profile_numeric_summary",
    "eval_summarize_pop",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="bench")
    qs = catalog.queries()
    # warm-up (not timed): JIT, codegen and the Parquet reader path
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("md5(cast(o_orderkey as string)) AS h") \
        .write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        if name not in qs:
            continue
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries on local[$BENCH_CPUS]; prints one JSON line.

Each query writes its full result to the noop sink, so nothing is collected.
The first query is run once beforehand, to start the JVM's classes.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from regionflow.plans.catalog import catalog
from regionflow.session import build_session, release

HEADLINE = [
    "region_report",
    "first_n_padded",
    "series_metrics",
    "loss_surface",
    "best_cell",
    "epoch_entity_summary",
    "reward_spread",
    "epoch_totals",
    "ema",
    "running_mean",
    "metrics_wide",
    "gravity_edges",
    "normalize_outbound",
    "apportion",
    "apportion_columns",
    "flow_step",
    "step_transition",
    "reward_main",
    "score_dense",
    "td_target",
    "keep_last_n",
    "sample_n_events",
    "weighted_sample",
    "update_priorities",
    "run_ids",
    "rolling_snapshot_agg",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    settings = {"spark.driver.memory": "16g", "spark.checkpoint.dir": shared}
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, settings)
    spark.sparkContext.setLogLevel("ERROR")
    runs = catalog()
    wanted = sys.argv[1:] or HEADLINE
    runs[wanted[0]].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    spent: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        runs[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 4) choose
data and cores. Results go to the no-op sink, so every row is computed but none
is sent to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "silver_cells", "fact_ran", "fact_cells", "hourly_wide", "model_features", "transport_stream",
    "latest_cells", "ran_weather_join", "alert_feed", "derived_alert_summary",
    "sem_avg_sinr_by_site", "sem_two_facts_by_region", "prediction_summary",
    "bucket_mode", "slot_pivot", "roll_features", "lag_backfill", "asof_join", "asof_weather",
    "sequence_gaps", "box_event_values",
]


def main() -> None:
    from mastline.session import build_session
    from mastline_queries import catalog, staging  # noqa: F401
    from mastline_queries.registry import SPARK

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    only = sys.argv[1:]
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(max(8, 2 * int(cpus))), "spark.ui.enabled": "false",
        "spark.driver.memory": "16g",
        "spark.checkpoint.dir": os.environ.get("SCRATCH_DIR", "/tmp/mastline-bench"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        t0 = time.time()
        run()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)

    # The pipeline's own writes come first; later queries read their tables.
    timed("stage_snapshots", lambda: staging.raw(spark, sf))
    timed("write_silver", lambda: staging.silver(spark, sf, "cells"))
    timed("write_gold", lambda: staging.star(spark, sf))
    timed("write_model_input", lambda: staging.wide(spark, sf))
    for name in only or HEADLINE:
        timed(name, lambda: SPARK[name](spark, sf).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()

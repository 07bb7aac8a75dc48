"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3, median reported).

The event reports run the way they run in production: over the GA event
table stored date-partitioned in Parquet (written once per run to the
shared folder, not timed), and, for ``journey_from_partials``, over the
per-day partial tables of the incremental path (also built once, not timed). Monitor queries run from their recorded
documents. Every query is fully executed with the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from milepost.plans import incremental as inc  # noqa: E402
from milepost.plans import journey as jr  # noqa: E402
from milepost.plans import monitor_registry as mr  # noqa: E402
from milepost.plans import new_users as nu  # noqa: E402
from milepost.plans.registry import AS_OF, materialized_events  # noqa: E402
from milepost.plans.stream_registry import STREAM_QUERIES  # noqa: E402
from milepost.session import build_session, scratch_path  # noqa: E402
from milepost.sources import events as evsrc  # noqa: E402
from milepost.sources import testdata as td  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus)

    t0 = time.time()
    ga_path = materialized_events(spark, sf_dir)

    def events():
        return evsrc.load_events(spark, ga_path)

    partials = scratch_path(spark, "bench-partials")
    inc.update_partials(events(), partials)
    prep = time.time() - t0

    excluded = td.excluded_users(spark, sf_dir)
    headline = {
        "user_journey": lambda: jr.user_journey(events(), AS_OF),
        "user_journey_joined": lambda: jr.user_journey_joined(events(), AS_OF),
        "journey_sql_text": lambda: jr.run_report(spark, jr.load_report_sql("user_journey"), events(), AS_OF),
        "journey_from_partials": lambda: inc.journey_from_partials(inc.read_partials(spark, partials), events(), AS_OF),
        "new_users_24h": lambda: nu.new_users(events(), AS_OF, excluded),
        "spend_alerts": lambda: mr.q_spend_alerts(spark, sf_dir),
        "availability_by_task": lambda: mr.MONITOR_QUERIES["availability_by_task"](spark, sf_dir),
        "worker_threshold": lambda: mr.q_worker_threshold(spark, sf_dir),
        "desired_workers": lambda: mr.q_desired_workers(spark, sf_dir),
        "alerts_union": lambda: mr.q_alerts_union(spark, sf_dir),
    }
    times: dict[str, float] = {}
    for name, build in headline.items():
        build().write.format("noop").mode("overwrite").save()  # warm-up
        samples = []
        for _ in range(runs):
            s = time.time()
            build().write.format("noop").mode("overwrite").save()
            samples.append(time.time() - s)
        times[name] = round(statistics.median(samples), 3)

    # One streaming job end to end (availableNow, includes start/stop).
    s = time.time()
    STREAM_QUERIES["stream_availability"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times["stream_availability"] = round(time.time() - s, 3)

    rows = events().select(F.count(F.lit(1))).first()[0]
    print(
        json.dumps(
            {
                "metric": "headline_total_sec",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": td.sf_of(sf_dir),
                "events": rows,
                "prep_sec": round(prep, 3),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

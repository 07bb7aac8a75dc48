"""Registered streaming queries: each runs its stream to completion
(``availableNow``) on the driver tables and returns the final table."""

from __future__ import annotations

from pyspark.sql import functions as F

from milepost.functions.specs import JOURNEY_NTH, Milestone
from milepost.plans import monitor_registry as mr
from milepost.session import scratch_path
from milepost.sources import streams as st
from milepost.sources import testdata as td
from milepost.sources.documents import AMOUNT
from milepost.streaming import jobs

# Milestones kept up to date by the stream (first and latest of each).
STREAM_SPECS = [
    Milestone("first_open", event="first_open"),
    Milestone("registration", event="onboarding_step1_registration_complete"),
    Milestone("phone_verified", event="onboarding_step3_phone_verified_complete"),
    Milestone("any_integration", like="integration_created_%"),
]


def _typed_event_stream(spark, sf_dir):
    return td.raw_to_typed(st.table_stream(spark, sf_dir, "events"))


def q_stream_daily_spend(spark, sf_dir):
    ev = _typed_event_stream(spark, sf_dir).filter(F.col("event_type") == "purchase")
    rows = ev.select(
        F.concat(F.lit("p"), (F.col("uid") % 2).cast("string")).alias("provider"),
        "ts",
        F.col("value").cast(AMOUNT).alias("amount"),
        "event_id",
    )
    soft, hard = mr.limits(sf_dir)
    return jobs.run_daily_spend(spark, rows, soft, hard, ids=("event_id",))


def q_stream_latch(spark, sf_dir):
    """Daily severity rows are written in three parts, days dealt out by hash,
    and streamed some files at a time, so days come in no order."""
    daily = mr.with_switch_outcome(mr.daily_severity(spark, sf_dir))
    folder = scratch_path(spark, "latch-input")
    part = F.pmod(F.xxhash64("provider", "day"), F.lit(3))
    daily.withColumn("_part", part).write.mode("overwrite").partitionBy("_part").parquet(folder)
    return jobs.run_latch(spark, st.parquet_stream(spark, folder, max_files_per_trigger=8))


def q_stream_availability(spark, sf_dir):
    probes = td.probe_records_from(_typed_event_stream(spark, sf_dir))
    return jobs.run_availability(spark, probes, rules=td.PROBE_RULES)


def q_stream_workers(spark, sf_dir):
    rows = td.endpoint_rows_from(st.table_stream(spark, sf_dir, "customer"))
    return jobs.run_workers(spark, rows, int(mr.WORKER_LIMIT_AT_001 * mr.scale(sf_dir)))


def q_stream_milestones(spark, sf_dir):
    ev = td.typed_to_ga(_typed_event_stream(spark, sf_dir))
    return jobs.run_milestones(spark, ev, STREAM_SPECS)


def q_stream_nth_milestones(spark, sf_dir):
    ev = td.typed_to_ga(_typed_event_stream(spark, sf_dir))
    return jobs.run_nth_milestones(spark, ev, JOURNEY_NTH)


STREAM_QUERIES = {
    "stream_daily_spend": q_stream_daily_spend,
    "stream_latch": q_stream_latch,
    "stream_availability": q_stream_availability,
    "stream_workers": q_stream_workers,
    "stream_milestones": q_stream_milestones,
    "stream_nth_milestones": q_stream_nth_milestones,
}

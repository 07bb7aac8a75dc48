"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Each key runs library code on the adapted driver tables at the fixed test
parameters of FIXTURES.md §4. Most keys return a lazy plan; stream keys run
their stream to completion (availableNow) and table-maintaining keys write
their tables to the shared folder before returning the final read. Size
checks for broadcasts run a bounded count while the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from milepost.functions import families as fam
from milepost.functions.specs import JOURNEY_FIRST, JOURNEY_NTH, NEW_USER_LATEST, SCREEN_LATEST
from milepost.functions.timefmt import cet_text
from milepost.operators import activity as act
from milepost.operators import milestones as ms
from milepost.operators.exclusion import exclude_users
from milepost.operators.params import explode_params
from milepost.plans import journey as jr
from milepost.plans import new_users as nu
from milepost.session import ensure_utc, scratch_path
from milepost.sources import events as evsrc
from milepost.sources import testdata as td

AS_OF = td.TEST_AS_OF
Query = Callable[[SparkSession, str], DataFrame]


def driver_types(df: DataFrame) -> DataFrame:
    """Zone-free output: TIMESTAMP columns become TIMESTAMP_NTZ (UTC wall
    clock) so that a reader in any session zone sees the same values."""
    cols = [
        F.col(f.name).cast(T.TimestampNTZType()).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


_MATERIALIZED: dict[tuple, str] = {}


def materialized_events(spark: SparkSession, sf_dir: str) -> str:
    """Write the adapted events once per Spark application as a
    date-partitioned Parquet table in the shared folder; return its path."""
    key = (sf_dir.rstrip("/"), spark.sparkContext.applicationId)
    if key not in _MATERIALIZED:
        path = scratch_path(spark, "ga-events")
        evsrc.write_events(td.ga_events(spark, sf_dir), path, mode="overwrite")
        _MATERIALIZED[key] = path
    return _MATERIALIZED[key]


def q_events_scan(spark, sf_dir):
    path = materialized_events(spark, sf_dir)
    ev = evsrc.load_events(spark, path, columns=["event_name"])
    return ev.groupBy("event_name").agg(F.count(F.lit(1)).alias("n"))


def q_explode_params(spark, sf_dir):
    rows = explode_params(td.ga_events(spark, sf_dir), keep=())
    return rows.groupBy("param_key").agg(F.count(F.lit(1)).alias("n"))


def q_cet_format(spark, sf_dir):
    ev = td.ga_events(spark, sf_dir)
    ts = ms.event_time()
    return ev.select("event_id", cet_text(ts).alias("event_time"), F.to_date(ts).alias("event_day"))


def _ev(f):
    def run(spark, sf_dir):
        return f(td.ga_events(spark, sf_dir))

    run.__doc__ = f.__doc__
    return run


(F5, N5, C5), (F8, N8, C8), (F9, N9, C9) = JOURNEY_NTH

EVENT_QUERIES: dict[str, Query] = {
    "events_scan": q_events_scan,
    "explode_params": q_explode_params,
    "cet_format": q_cet_format,
    "event_family_counts": _ev(lambda ev: act.family_counts(ev)),
    "milestones_first": _ev(lambda ev: ms.format_cet(ms.first_milestones(ev, JOURNEY_FIRST), [m.column for m in JOURNEY_FIRST])),
    "milestones_latest": _ev(lambda ev: ms.format_cet(ms.latest_milestones(ev, NEW_USER_LATEST), [m.column for m in NEW_USER_LATEST])),
    "screen_milestones": _ev(lambda ev: ms.format_cet(ms.latest_milestones(ev, SCREEN_LATEST), [m.column for m in SCREEN_LATEST])),
    "first_message": _ev(lambda ev: ms.format_cet(ms.first_event(ev, fam.MESSAGES, jr.JOURNEY_FIRST_OF[0][1]), [jr.JOURNEY_FIRST_OF[0][1]])),
    "first_interaction": _ev(lambda ev: ms.format_cet(ms.first_event(ev, fam.INTERACTIONS, jr.JOURNEY_FIRST_OF[1][1]), [jr.JOURNEY_FIRST_OF[1][1]])),
    "nth_integration": _ev(lambda ev: ms.format_cet(ms.nth_event(ev, F5, N5, C5), [C5])),
    "nth_message": _ev(lambda ev: ms.format_cet(ms.nth_event(ev, F8, N8, C8), [C8])),
    "nth_interaction": _ev(lambda ev: ms.format_cet(ms.nth_event(ev, F9, N9, C9), [C9])),
    "first_user_id": _ev(lambda ev: ms.first_value_at(ev, fam.PHONE_VERIFIED, "user_id")),
    "active_days": _ev(lambda ev: act.active_days(ev)),
    "active_days_recent": _ev(lambda ev: act.active_days(ev, AS_OF, 7)),
    "activity_flags": _ev(
        lambda ev: act.activity_flags(
            act.active_days(ev), [(t, f"is_active_on_day_{t}") for t in (24, 26, 28)]
        )
    ),
    "screen_recency": _ev(lambda ev: ms.format_cet(act.screen_recency(ev, AS_OF), ["last_screen_view"])),
    "user_location": _ev(lambda ev: act.any_location(ev)),
    "error_counts": _ev(lambda ev: act.event_count(ev)),
    "user_journey": _ev(lambda ev: jr.user_journey(ev, AS_OF)),
    "user_journey_joined": _ev(lambda ev: jr.user_journey_joined(ev, AS_OF)),
    "user_journey_step3_all": _ev(lambda ev: jr.user_journey(ev, AS_OF, scope="all_events")),
}


def q_exclude_users(spark, sf_dir):
    ev = td.ga_events(spark, sf_dir).select("event_id", "user_pseudo_id", "user_id")
    return exclude_users(ev, td.excluded_users(spark, sf_dir), "user_id")


def q_journey_sql_text(spark, sf_dir):
    ev = td.ga_events(spark, sf_dir)
    return jr.run_report(spark, jr.load_report_sql("user_journey"), ev, AS_OF)


def q_user_journey_incremental(spark, sf_dir):
    """Journey report from per-day partial tables: built in two updates
    (days before as_of's date, then the rest), the last day re-run once
    (idempotent), then merged with a pruned scan of recent raw events."""
    from milepost.functions.timefmt import parse_as_of
    from milepost.plans import incremental as inc

    ev = td.ga_events(spark, sf_dir)
    base = scratch_path(spark, "journey-partials")
    cut = parse_as_of(AS_OF).date()
    inc.update_partials(ev.filter(F.col("event_date") < F.lit(cut)), base)
    inc.update_partials(ev.filter(F.col("event_date") >= F.lit(cut)), base)
    inc.update_partials(ev.filter(F.col("event_date") == F.lit(cut)), base)
    return inc.journey_from_partials(inc.read_partials(spark, base), ev, AS_OF)


def q_new_users_24h(spark, sf_dir):
    ev = td.ga_events(spark, sf_dir)
    return nu.new_users(ev, AS_OF, td.excluded_users(spark, sf_dir), hours=24)


EVENT_QUERIES.update(
    {
        "exclude_users": q_exclude_users,
        "journey_sql_text": q_journey_sql_text,
        "user_journey_incremental": q_user_journey_incremental,
        "new_users_24h": q_new_users_24h,
    }
)


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(EVENT_QUERIES)
    from milepost.plans.monitor_registry import MONITOR_QUERIES

    out.update(MONITOR_QUERIES)
    from milepost.plans.stream_registry import STREAM_QUERIES

    out.update(STREAM_QUERIES)

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return driver_types(fn(spark, sf_dir))

        run.__doc__ = fn.__doc__
        return run

    return {k: wrap(v) for k, v in out.items()}

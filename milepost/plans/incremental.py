"""Incremental maintenance of the journey report.

The daily report needs lifetime milestones, so recomputing it from every
event each day costs O(history). Here the work is split:

* ``update_partials`` turns the events of the days that changed into four
  small per-day tables, written as a new version, and switches those days of
  all four tables at once (re-running a day, e.g. after late events, replaces
  it and never duplicates it);
* ``journey_from_partials`` merges the partials and adds the only
  ``as_of``-dependent part, the 24/48/72 h screen counts, from a scan of
  the last few days of raw events (partition-pruned).

Tables below ``base`` (``<table>/version=<v>/event_date=<day>``, see
:mod:`milepost.plans.versions`):

``days``     per (user, day) the first level of the fused plan, both milestone
             scopes; its bitmaps hold UTC days, ``event_date`` may be a local day
``heads``    per (user, family, day) the first 10 family events; the overall
             n-th event (n <= 10) is always among them, because an event that
             is not among the first 10 of its own day has 10 earlier ones
``cities``   distinct (user, day, city)
``verified`` per (user, day) the first verified-phone event and its user id
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from milepost.functions import families as fam
from milepost.functions.specs import JOURNEY_NTH, JOURNEY_RECENT_DAYS, JOURNEY_THRESHOLDS, SCREEN_HOURS
from milepost.operators import activity as act
from milepost.operators.milestones import USER, event_time
from milepost.plans import journey as jr
from milepost.plans.versions import VersionedTables
from milepost.sources.events import EVENT_SCHEMA

HEAD_SIZE = 10
#: Rows that only make a day's partition exist.
MARKER = "is_marker"
TABLES = ("days", "heads", "cities", "verified")


def family_heads(ev: DataFrame, wanted=JOURNEY_NTH, size: int = HEAD_SIZE) -> DataFrame:
    """First ``size`` events per (user, family, day), as rows."""
    if max(n for _, n, _ in wanted) > size:
        raise ValueError("n-th milestones beyond the head size cannot be rebuilt from partials")
    name = F.col("event_name")
    families = [f for f, _, _ in wanted]
    tags = F.filter(F.array(*[F.when(f.predicate(), F.lit(f.name)) for f in families]), lambda x: x.isNotNull())
    pre = F.lit(False)
    for f in families:
        pre = pre | f.prefilter()
    rows = ev.filter(pre).select(USER, "event_date", "event_timestamp", "event_id", F.explode(tags).alias("family"))
    w = Window.partitionBy(USER, "family", "event_date").orderBy("event_timestamp", "event_id")
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= size).drop("_rn")


def day_tables(ev: DataFrame) -> dict[str, DataFrame]:
    """The four per-day tables for the given events."""
    cities = ev.groupBy(USER, "event_date", F.col("geo.city").alias("city")).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct("event_timestamp", "event_id", "user_id"))
    verified = (
        ev.filter(F.col("event_name") == fam.PHONE_VERIFIED)
        .groupBy(USER, "event_date")
        .agg(first.alias("_f"))
        .select(USER, "event_date", "_f.*")
    )
    return {
        "days": jr.day_level(ev, ("cohort", "all_events")),
        "heads": family_heads(ev),
        "cities": cities,
        "verified": verified,
    }


def update_partials(ev: DataFrame, base: str, days: Sequence[date] = ()) -> None:
    """Replace the per-day tables' rows of the days present in ``ev`` (pass the
    events of the changed days, e.g. ``load_events(..., date_from=d,
    date_to=d)``) and of ``days``, which may have lost all their events.
    Rows of other days are kept.

    The four tables are written as a new version beside the old ones, and one
    manifest, committed last, switches the changed days of all four at once.
    After a failure before that, readers still see the old report; running the
    same days again writes another version. Each replaced day gets a marker
    row in every table, so that a table without rows for that day loses its
    old ones too.
    """
    spark = ev.sparkSession
    named = spark.createDataFrame([(d,) for d in days], "event_date date")
    changed = ev.select("event_date").unionByName(named).distinct().withColumn(MARKER, F.lit(True))
    tables = VersionedTables(spark, base)
    version = tables.new_version()
    for name, df in day_tables(ev).items():
        df = df.withColumn(MARKER, F.lit(False)).unionByName(changed, allowMissingColumns=True)
        # range partitioning on (day, user): a one-day update is still
        # written by many tasks and files hold user ranges; without a fixed
        # count AQE merges small ranges into fewer, larger files
        df.repartitionByRange("event_date", USER).write.partitionBy("event_date").parquet(tables.folder(name, version))
    tables.commit(version, tables.partitions(TABLES[0], version))


def partial_schemas(spark: SparkSession) -> dict:
    """Schemas of the per-day tables, taken from their builders (no job)."""
    empty = spark.createDataFrame([], EVENT_SCHEMA)
    return {name: df.schema for name, df in day_tables(empty).items()}


def read_partials(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Open the per-day tables as of the last committed manifest, with their
    known schemas, so a table that got no rows yet (e.g. no verified-phone
    event so far) reads as empty."""
    schemas = partial_schemas(spark)
    tables = VersionedTables(spark, base)
    live = tables.live()  # read once: all tables show the same report
    out = {}
    for name in TABLES:
        schema = StructType([*schemas[name].fields, StructField(MARKER, BooleanType())])
        rows = tables.read(name, schema, live)
        out[name] = rows.filter(~F.coalesce(F.col(MARKER), F.lit(False))).drop(MARKER)
    return out


def journey_from_partials(
    parts: dict[str, DataFrame],
    recent_events: DataFrame,
    as_of,
    scope: str = "cohort",
    recent_days: int = JOURNEY_RECENT_DAYS,
    thresholds=JOURNEY_THRESHOLDS,
    hours=SCREEN_HOURS,
) -> DataFrame:
    """The journey report from the per-day tables plus raw events of the
    last days (only events at or after ``as_of - max(hours)`` are used; the
    scan is pruned on ``event_date``)."""
    l2 = jr.user_level(parts["days"], as_of, scope, recent_days)

    recent = act.recent_screen_counts(recent_events, as_of, hours)

    top = max(n for _, n, _ in JOURNEY_NTH)
    w = Window.partitionBy(USER, "family").orderBy("event_timestamp", "event_id")
    ranked = parts["heads"].withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top)
    nth = ranked.groupBy(USER).agg(
        *[
            F.max(F.when((F.col("family") == f.name) & (F.col("_rn") == n), event_time())).alias(col)
            for f, n, col in JOURNEY_NTH
        ]
    )

    location = parts["cities"].groupBy(USER).agg(F.min(F.when(F.col("n") > 0, F.col("city"))).alias("location"))
    verified = (
        parts["verified"]
        .groupBy(USER)
        .agg(F.min(F.struct("event_timestamp", "event_id", "user_id"))["user_id"].alias("user_id"))
    )
    joined = (
        l2.join(recent, USER, "left")
        .join(nth, USER, "left")
        .join(location, USER, "left")
        .join(verified, USER, "left")
    )
    return jr.finish(joined, thresholds, hours)

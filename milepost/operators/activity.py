"""Activity sides of the journey report: active days, flags, screen
recency, error counts and location."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.functions import families as fam
from milepost.functions.daybits import bit_of, block_of, count_days
from milepost.functions.timefmt import hours_before, parse_as_of, utc_day
from milepost.operators.milestones import USER, event_time


def active_days(ev: DataFrame, as_of=None, days: int | None = None, column: str | None = None) -> DataFrame:
    """Distinct UTC days (of the event's time) with a named event per user.

    With ``as_of``/``days`` only days ``>= DATE(as_of) - days`` count
    (inclusive bound, no upper bound). Partitions are pruned with a day of
    margin, as ``event_date`` may be a local day.
    """
    rows = ev.filter(F.col("event_name").isNotNull())
    if days is not None:
        if as_of is None:
            raise ValueError("days needs as_of")
        first = parse_as_of(as_of).date() - timedelta(days=days)
        rows = rows.filter(F.col("event_date") >= F.lit(first - timedelta(days=1)))
        rows = rows.filter(utc_day(event_time()) >= F.lit(first))
        column = column or "days_active"
    else:
        column = column or "total_active_days"
    ts = event_time()
    blocks = rows.groupBy(USER, block_of(ts).alias("_block")).agg(F.bit_or(bit_of(ts)).alias("_bits"))
    return blocks.groupBy(USER).agg(F.sum(count_days(F.col("_bits"))).alias(column))


def activity_flags(days_df: DataFrame, thresholds: list[tuple[int, str]], column: str = "total_active_days") -> DataFrame:
    """One boolean per threshold: at least ``t`` active days ever."""
    return days_df.select(
        USER, column, *[(F.col(column) >= F.lit(t)).alias(name) for t, name in thresholds]
    )


def screen_param_count():
    """Number of parameters naming a screen (key firebase_screen, value not
    NULL). The source counts unnested parameter rows, so a duplicated key
    counts twice."""
    return F.size(
        F.filter(
            F.col("event_params"),
            lambda p: (p["key"] == F.lit(fam.SCREEN_PARAM)) & p["value"]["string_value"].isNotNull(),
        )
    )


def screen_recency(ev: DataFrame, as_of, hours=(24, 48, 72)) -> DataFrame:
    """Latest qualifying screen view and cumulative counts in the last
    24/48/72 hours before ``as_of`` (no upper bound)."""
    rows = ev.filter(F.col("event_name") == fam.SCREEN_VIEW).select(
        USER, "event_timestamp", screen_param_count().alias("_np")
    ).filter(F.col("_np") > 0)
    ts = event_time()
    return rows.groupBy(USER).agg(
        F.max(ts).alias("last_screen_view"),
        *[
            F.coalesce(F.sum(F.when(ts >= hours_before(as_of, h), F.col("_np"))), F.lit(0))
            .cast("long")
            .alias(f"screen_views_last_{h}h")
            for h in hours
        ],
    )


def recent_screen_counts(ev: DataFrame, as_of, hours=(24, 48, 72)) -> DataFrame:
    """Per user, screen parameters counted in the last ``h`` hours before
    ``as_of`` (cumulative windows, no upper bound) as ``_sv<h>``. Only the
    partitions from a day before ``DATE(as_of - max(hours))`` on are read,
    as ``event_date`` may be a local day."""
    earliest = parse_as_of(as_of) - timedelta(hours=max(hours), days=1)
    name = F.col("event_name")
    np_ = F.when(name == fam.SCREEN_VIEW, screen_param_count()).otherwise(F.lit(0))
    ts = event_time()
    rows = (
        ev.filter(F.col("event_date") >= F.lit(earliest.date()))
        .filter((name == fam.SCREEN_VIEW) & (ts >= hours_before(as_of, max(hours))))
        .select(USER, "event_timestamp", np_.alias("_np"))
        .filter(F.col("_np") > 0)
    )
    return rows.groupBy(USER).agg(*[F.sum(F.when(ts >= hours_before(as_of, h), F.col("_np"))).alias(f"_sv{h}") for h in hours])


def any_location(ev: DataFrame) -> DataFrame:
    """One city per user (smallest non-NULL; the source takes any value).

    (user, city) pairs are deduplicated first with a hash aggregate (string
    keys are fine there); only the few pairs reach the MIN over strings,
    which Spark runs as a sort-based aggregate.
    """
    pairs = ev.groupBy(USER, F.col("geo.city").alias("location")).agg(F.count(F.lit(1)).alias("_n"))
    # Referencing the pair count keeps Catalyst from folding the DISTINCT
    # step into the MIN (it would, MIN being duplicate-insensitive).
    return pairs.groupBy(USER).agg(F.min(F.when(F.col("_n") > 0, F.col("location"))).alias("location"))


def event_count(ev: DataFrame, event_name: str = fam.USER_FACING_ERROR, column: str = "user_error_count") -> DataFrame:
    """Rows per user with ``event_name``."""
    return ev.filter(F.col("event_name") == event_name).groupBy(USER).agg(F.count(F.lit(1)).alias(column))


def family_counts(ev: DataFrame, families=None) -> DataFrame:
    """Events and distinct users per event family.

    An event may belong to several families (a named integration is also
    an integration), so each event is exploded into its families first.
    """
    families = families or fam.FAMILIES
    name = F.col("event_name")
    tags = F.filter(F.array(*[F.when(f.predicate(), F.lit(f.name)) for f in families]), lambda x: x.isNotNull())
    rows = ev.select(USER, F.explode(tags).alias("family"))
    return rows.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(USER).alias("users")
    )

"""User-journey report (21 columns), fused and joined plans.

``user_journey`` is the plan to run at scale, with two scans of the events:

* all events, hash-aggregated per (user, block of 64 UTC days, city) with
  fixed-width buffers only (cohort flag, first milestones, screen views, errors,
  and the active days as a bitmap), then per user: bitmaps of a block merge by
  bitwise OR, and the city is text only in these few rows;
* the events of four families (named integrations, messages, interactions,
  verified phone), tagged and ranked per (user, family) for the n-th ones.

``user_journey_joined`` keeps the shape of the source report (one side table per
column group, eleven left joins) and serves as its checker; both must return
identical rows. ``TIME_COLUMNS`` are printed as CET text.
"""

from __future__ import annotations

from datetime import timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.functions import families as fam
from milepost.functions.daybits import bit_of, block_of, count_days, days_since
from milepost.functions.specs import (
    JOURNEY_COLUMNS,
    JOURNEY_FIRST,
    JOURNEY_FIRST_OF,
    JOURNEY_NTH,
    JOURNEY_RECENT_DAYS,
    JOURNEY_THRESHOLDS,
    SCREEN_HOURS,
)
from milepost.functions.timefmt import cet_text, hours_before, parse_as_of
from milepost.operators import activity as act
from milepost.operators import milestones as ms
from milepost.operators.milestones import USER, event_time

TIME_COLUMNS = [
    "step1_first_open",
    "last_screen_view",
    "step2_registers_account",
    "step3_provides_permission",
    "step4_connects_1_integration",
    "step5_connects_3_integrations",
    "step6_receives_and_opens_1st_message_or_email",
    "step7_sends_1st_email_or_message_or_status_share",
    "step8_receives_and_opens_10th_msg_or_email",
    "step9_sends_5th_email_message_status_share",
]

ALL_EVENTS_SUFFIX = "__all"


def _check_scope(scope: str) -> None:
    if scope not in ("cohort", "all_events"):
        raise ValueError(f"unknown scope {scope!r}")


BLOCK, BITS = "_block", "_bits"


def day_level(ev: DataFrame, scopes=("cohort",), as_of=None, hours=(), with_firsts: bool = True, keys=("event_date",)) -> DataFrame:
    """Level 1: one row per (user, block of days, ``keys``), fixed-width
    buffers only; ``_bits`` are the days with a named event.

    With ``scopes`` the cohort flag and first-milestone columns are added,
    named after the spec for the 'cohort' scope and with ``__all`` appended
    for the 'all_events' scope. The screen counts relative to ``as_of`` are
    included only when ``hours`` is given; the first message / interaction
    times only with ``with_firsts``. ``keys`` are columns, or (alias, column).
    """
    name = F.col("event_name")
    ts = event_time()
    in_cohort = fam.COHORT.predicate()
    np_ = F.when(name == fam.SCREEN_VIEW, act.screen_param_count()).otherwise(F.lit(0))
    named = [(k, F.col(k)) if isinstance(k, str) else k for k in keys]
    base = ev.select(
        USER,
        *[c.alias(k) for k, c in named],
        block_of(ts).alias(BLOCK),
        "event_timestamp",
        "event_name",
        np_.alias("_np"),
        in_cohort.alias("_c"),
    )
    c, npc = F.col("_c"), F.col("_np")
    first_aggs = []
    for scope in scopes:
        _check_scope(scope)
        for m in JOURNEY_FIRST:
            cond = m.predicate(name) & c if scope == "cohort" else m.predicate(name)
            alias = m.column if scope == "cohort" else m.column + ALL_EVENTS_SUFFIX
            first_aggs.append(F.min(F.when(cond, ts)).alias(alias))
    return base.groupBy(USER, *[k for k, _ in named], BLOCK).agg(
        *([F.max(c).alias("_cohort")] if scopes else []),
        *first_aggs,
        F.max(F.when(npc > 0, ts)).alias("last_screen_view"),
        F.sum(npc).alias("_screen_rows"),
        *[F.sum(F.when(ts >= hours_before(as_of, h), npc)).alias(f"_sv{h}") for h in hours],
        *([F.min(F.when(f.predicate(), ts)).alias(col) for f, col in JOURNEY_FIRST_OF] if with_firsts else []),
        F.bit_or(F.when(name.isNotNull(), bit_of(ts))).alias(BITS),
        F.count(F.when(name == fam.USER_FACING_ERROR, F.lit(1))).alias("_errors"),
    )


def user_level(days: DataFrame, as_of, scope: str = "cohort", recent_days: int = JOURNEY_RECENT_DAYS) -> DataFrame:
    """Levels 2 and 3: merge the rows of each (user, block), then of each
    user; active days are counted from the merged bitmaps (no DISTINCT, no
    Expand). Only the columns present in ``days`` are merged; with a cohort
    flag present, only cohort users stay."""
    _check_scope(scope)
    suffix = "" if scope == "cohort" else ALL_EVENTS_SUFFIX
    firsts = [m.column for m in JOURNEY_FIRST] + [col for _, col in JOURNEY_FIRST_OF]
    renamed = {m.column + suffix: m.column for m in JOURNEY_FIRST} if suffix and JOURNEY_FIRST[0].column + suffix in days.columns else {}
    rows = days.drop(*renamed.values()).withColumnsRenamed(renamed)
    merged = {"_cohort": F.max, "last_screen_view": F.max, "_screen_rows": F.sum, "_errors": F.sum, "location": F.min}
    merged |= {c: F.min for c in firsts} | {c: F.sum for c in rows.columns if c.startswith("_sv")}

    def merge(columns: list[str]) -> list[Column]:
        return [agg(c).alias(c) for c, agg in merged.items() if c in columns]

    blocks = rows.groupBy(USER, BLOCK).agg(*merge(rows.columns), F.bit_or(BITS).alias(BITS))
    cutoff = parse_as_of(as_of).date() - timedelta(days=recent_days)
    out = blocks.groupBy(USER).agg(
        *merge(rows.columns),
        F.sum(count_days(F.col(BITS))).alias("_days"),
        F.sum(count_days(days_since(F.col(BLOCK), F.col(BITS), cutoff))).alias("_recent"),
    )
    return out.filter(F.col("_cohort")) if "_cohort" in out.columns else out


def finish(joined: DataFrame, thresholds=JOURNEY_THRESHOLDS, hours=SCREEN_HOURS) -> DataFrame:
    """Final 21 columns from the user level joined with its sides.

    The source joins side tables on the user key; a NULL key never matches,
    so its side columns are NULL / default (Q9). Screen columns are NULL for
    users without a qualifying screen view and 0 when all are old (Q7).
    """
    keyed = F.col(USER).isNotNull()
    has_screen = keyed & (F.col("_screen_rows") > 0)

    def side(col):
        return F.when(keyed, F.col(col))

    def text(c):
        return cet_text(c) if isinstance(c, Column) else cet_text(F.col(c))

    out = joined.select(
        USER,
        side("user_id").alias("user_id"),
        text("step1_first_open").alias("step1_first_open"),
        side("location").alias("location"),
        text(F.when(has_screen, F.col("last_screen_view"))).alias("last_screen_view"),
        *[
            F.when(has_screen, F.coalesce(F.col(f"_sv{h}"), F.lit(0)).cast("long")).alias(f"screen_views_last_{h}h")
            for h in hours
        ],
        text("step2_registers_account").alias("step2_registers_account"),
        text("step3_provides_permission").alias("step3_provides_permission"),
        text("step4_connects_1_integration").alias("step4_connects_1_integration"),
        text("step5_connects_3_integrations").alias("step5_connects_3_integrations"),
        text(side("step6_receives_and_opens_1st_message_or_email")).alias("step6_receives_and_opens_1st_message_or_email"),
        text(side("step7_sends_1st_email_or_message_or_status_share")).alias("step7_sends_1st_email_or_message_or_status_share"),
        text("step8_receives_and_opens_10th_msg_or_email").alias("step8_receives_and_opens_10th_msg_or_email"),
        text("step9_sends_5th_email_message_status_share").alias("step9_sends_5th_email_message_status_share"),
        *[(keyed & (F.col("_days") >= F.lit(t))).alias(col) for t, col in thresholds],
        F.when(keyed, F.col("_recent")).otherwise(F.lit(0)).cast("long").alias("step17_days_active_in_last_30_days"),
        F.when(keyed, F.col("_errors")).otherwise(F.lit(0)).cast("long").alias("user_error_count"),
    )
    return out


def user_journey(
    ev: DataFrame,
    as_of,
    scope: str = "cohort",
    recent_days: int = JOURNEY_RECENT_DAYS,
    thresholds=JOURNEY_THRESHOLDS,
    hours=SCREEN_HOURS,
) -> DataFrame:
    """The journey report as a fused plan (see module doc).

    Four hash exchanges: (user, block, city) and user for the first scan,
    (user, family) and user for the second. The NULL user key is a group like
    any other in the first and matches nothing in the second (Q9)."""
    _check_scope(scope)
    facts = day_level(ev, (scope,), as_of, hours, with_firsts=False, keys=[("location", F.col("geo.city"))])
    # By user: satisfies the grouping by (user, block) and that by user.
    users = user_level(facts.repartition(USER), as_of, scope, recent_days)
    ranked = ms.nth_events(
        ev, JOURNEY_NTH + [(f, 1, col) for f, col in JOURNEY_FIRST_OF], [(fam.VERIFIED, 1, "user_id", "user_id")]
    )
    return finish(users.join(ranked, USER, "left"), thresholds, hours)


def user_journey_joined(
    ev: DataFrame,
    as_of,
    scope: str = "cohort",
    recent_days: int = JOURNEY_RECENT_DAYS,
    thresholds=JOURNEY_THRESHOLDS,
    hours=SCREEN_HOURS,
) -> DataFrame:
    """The journey report with one side table per column group, left-joined
    on the user key (the shape of the source report)."""
    cohort = ms.first_milestones(ev, JOURNEY_FIRST, scope=scope)
    (f5, n5, c5), (f8, n8, c8), (f9, n9, c9) = JOURNEY_NTH
    (f6, c6), (f7, c7) = JOURNEY_FIRST_OF
    sides = [
        act.any_location(ev),
        act.screen_recency(ev, as_of, hours),
        ms.nth_event(ev, f5, n5, c5),
        ms.first_event(ev, f6, c6),
        ms.first_event(ev, f7, c7),
        ms.nth_event(ev, f8, n8, c8),
        ms.nth_event(ev, f9, n9, c9),
        act.activity_flags(act.active_days(ev), thresholds).drop("total_active_days"),
        act.active_days(ev, as_of, recent_days, column="step17_days_active_in_last_30_days"),
        ms.first_value_at(ev, fam.PHONE_VERIFIED, "user_id"),
        act.event_count(ev, fam.USER_FACING_ERROR, "user_error_count"),
    ]
    df = cohort
    for s in sides:
        df = df.join(s, USER, "left")
    defaults = {col: F.lit(False) for _, col in thresholds}
    defaults["step17_days_active_in_last_30_days"] = F.lit(0)
    defaults["user_error_count"] = F.lit(0)
    out = df.select(
        *[
            F.coalesce(F.col(c), defaults[c]).cast("long" if c in ("step17_days_active_in_last_30_days", "user_error_count") else "boolean").alias(c)
            if c in defaults
            else F.col(c)
            for c in JOURNEY_COLUMNS
        ]
    )
    return ms.format_cet(out, TIME_COLUMNS)


def journey_report(ev: DataFrame, as_of, **kw) -> DataFrame:
    """The report in its published order: latest first_open first (NULLs
    last), then user key so that equal CET texts have a stable order."""
    return user_journey(ev, as_of, **kw).orderBy(F.col("step1_first_open").desc_nulls_last(), F.col(USER))


# --------------------------------------------------------------------------
# Report kept as SQL text, run by name with a bound ``as_of`` parameter.
# --------------------------------------------------------------------------
SQL_DIR = Path(__file__).with_name("sql")


def load_report_sql(name: str) -> str:
    return (SQL_DIR / f"{name}.sql").read_text()


def run_report(spark: SparkSession, sql_text: str, events: DataFrame, as_of) -> DataFrame:
    """Run a report kept as SQL text. ``{events}`` in the text is bound to
    the DataFrame and ``:as_of`` to the evaluation time (named parameter,
    not string concatenation)."""
    return spark.sql(sql_text, args={"as_of": parse_as_of(as_of)}, events=events)

"""Per-user milestones: first, latest and n-th matching event.

All builders return one row per user key with UTC TIMESTAMP columns;
:func:`format_cet` turns them into the report's CET text at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from milepost.functions import families as fam
from milepost.functions.families import EventFamily
from milepost.functions.specs import Milestone
from milepost.functions.timefmt import cet_text, to_instant

USER = "user_pseudo_id"


def event_time() -> Column:
    return to_instant(F.col("event_timestamp"))


def format_cet(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace TIMESTAMP columns by CET text, keeping column order."""
    keep = set(columns)
    return df.select(*[cet_text(F.col(c)).alias(c) if c in keep else F.col(c) for c in df.columns])


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def first_milestones(
    ev: DataFrame,
    specs: list[Milestone],
    cohort: EventFamily = fam.COHORT,
    scope: str = "cohort",
) -> DataFrame:
    """Cohort users and the first time of each milestone.

    ``scope='cohort'`` evaluates milestones only on cohort events, as the
    source report does (its step3 column can never match); ``'all_events'``
    evaluates them on every event of a cohort user.
    """
    if scope not in ("cohort", "all_events"):
        raise ValueError(f"unknown scope {scope!r}")
    name = F.col("event_name")
    in_cohort = cohort.predicate()
    conds = [m.predicate(name) for m in specs]
    rows = ev.filter(cohort.prefilter() & in_cohort) if scope == "cohort" else ev.filter(in_cohort | _any(conds))
    ts = event_time()
    aggs = [
        F.min(F.when(c & in_cohort if scope == "cohort" else c, ts)).alias(m.column)
        for m, c in zip(specs, conds)
    ]
    return (
        rows.groupBy(USER)
        .agg(F.max(in_cohort).alias("_cohort"), *aggs)
        .filter(F.col("_cohort"))
        .drop("_cohort")
    )


def latest_milestones(ev: DataFrame, specs: list[Milestone], with_identity: bool = False) -> DataFrame:
    """Latest time of each milestone per user, over events that carry at
    least one parameter (the source query unnests the parameter array, so
    parameter-less events drop out before aggregation).

    Screen milestones test the parameters with ``exists`` instead of
    unnesting: MAX is unchanged by duplicates, and no row is multiplied.
    """
    name, params = F.col("event_name"), F.col("event_params")
    rows = ev.filter(F.size(params) > 0)
    ts = event_time()
    aggs = [F.max(F.when(m.predicate(name, params), ts)).alias(m.column) for m in specs]
    if not with_identity:
        return rows.groupBy(USER).agg(*aggs)
    # ANY_VALUE ignores NULLs; the smallest non-NULL value is one legal,
    # deterministic choice. String MIN needs a sort-based aggregate, so events
    # are first hash-aggregated per (user, id, city), where both are keys; the
    # rows of a user are then merged. A NULL user is a group like any other.
    parts = rows.groupBy(USER, "user_id", F.col("geo.city").alias("city")).agg(*aggs)
    merged = parts.groupBy(USER).agg(
        F.min("user_id").alias("User_ID"), F.min("city").alias("Location"), *[F.max(m.column).alias(m.column) for m in specs]
    )
    return merged.select(USER, "User_ID", "Location", *[m.column for m in specs])


def first_event(ev: DataFrame, family: EventFamily, column: str) -> DataFrame:
    """First time per user of any event in ``family``."""
    name = F.col("event_name")
    rows = ev.filter(family.prefilter() & family.predicate())
    return rows.groupBy(USER).agg(F.min(event_time()).alias(column))


def nth_event(ev: DataFrame, family: EventFamily, n: int, column: str) -> DataFrame:
    """Time of the n-th event (1-based) of ``family`` per user.

    Ordered by (event_timestamp, event_id); the id breaks ties the source
    left arbitrary. ``rn = n`` plans a WindowGroupLimit that keeps at most
    n rows per user in every map task, so a hot user cannot flood one task.
    """
    name = F.col("event_name")
    rows = ev.filter(family.prefilter() & family.predicate()).select(USER, "event_timestamp", "event_id")
    w = Window.partitionBy(USER).orderBy("event_timestamp", "event_id")
    return (
        rows.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") == n)
        .select(USER, event_time().alias(column))
    )


def nth_events(
    ev: DataFrame,
    wanted: list[tuple[EventFamily, int, str]],
    values: list[tuple[EventFamily, int, str, str]] = (),
) -> DataFrame:
    """Several n-th milestones in one pass: one window over (user, family)
    with ``rn <= max n``, then a pivot by conditional MAX. A family may be
    asked for several n (n = 1 gives its first event). ``values`` asks for a
    column of the n-th event instead of its time: (family, n, column, alias)."""
    families = list({f.name: f for f, *_ in [*wanted, *values]}.values())
    code = {f.name: i for i, f in enumerate(families)}  # a byte per shuffled row, not a name
    pre = _any([f.prefilter() for f in families])
    source = sorted({c for _, _, c, _ in values})
    if fam.disjoint(families):
        # at most one family per event: one CASE column, no row generation
        tag = None
        for f in families:
            lit = F.lit(code[f.name]).cast("tinyint")
            tag = F.when(f.predicate(), lit) if tag is None else tag.when(f.predicate(), lit)
        rows = ev.filter(pre).select(USER, "event_timestamp", "event_id", *source, tag.alias("_family"))
        rows = rows.filter(F.col("_family").isNotNull())
    else:
        tags = F.filter(
            F.array(*[F.when(f.predicate(), F.lit(code[f.name]).cast("tinyint")) for f in families]),
            lambda x: x.isNotNull(),
        )
        rows = ev.filter(pre).select(USER, "event_timestamp", "event_id", *source, F.explode(tags).alias("_family"))
    # A column travels only with the families that are asked for it.
    kept = {c: [code[f.name] for f, _, own, _ in values if own == c] for c in source}
    rows = rows.select(
        USER, "event_timestamp", "event_id", "_family", *[F.when(F.col("_family").isin(k), F.col(c)).alias(c) for c, k in kept.items()]
    )
    w = Window.partitionBy(USER, "_family").orderBy("event_timestamp", "event_id")
    top = max(n for _, n, *_ in [*wanted, *values])
    ranked = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top)

    def nth(f: EventFamily, n: int, value: Column) -> Column:
        return F.max(F.when((F.col("_family") == code[f.name]) & (F.col("_rn") == n), value))

    return ranked.groupBy(USER).agg(
        *[nth(f, n, event_time()).alias(col) for f, n, col in wanted],
        *[nth(f, n, F.col(c)).alias(col) for f, n, c, col in values],
    )


def first_value_at(ev: DataFrame, event_name: str, column: str = "user_id") -> DataFrame:
    """``column`` of each user's first ``event_name`` event (row_number = 1).

    MIN over (event_timestamp, event_id, value) picks the same row as the
    window, keeps a NULL value when that row has one, and aggregates
    partially on the map side.
    """
    rows = ev.filter(F.col("event_name") == event_name)
    first = F.min(F.struct("event_timestamp", "event_id", F.col(column).alias("v")))
    return rows.groupBy(USER).agg(first["v"].alias(column))

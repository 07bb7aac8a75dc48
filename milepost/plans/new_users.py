"""New users of the last N hours with their latest onboarding milestones
(30 columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.functions.specs import NEW_USER_LATEST
from milepost.functions.timefmt import hours_before
from milepost.operators import milestones as ms
from milepost.operators.exclusion import exclude_users
from milepost.operators.milestones import USER


def new_users(
    ev: DataFrame,
    as_of,
    excluded: DataFrame,
    hours: int = 24,
    specs=NEW_USER_LATEST,
) -> DataFrame:
    """Users whose latest ``first_open`` is at most ``hours`` before
    ``as_of`` (no upper bound), minus listed test users (NULL ids stay).

    Only events with parameters count (the source unnests them). One scan:
    events are aggregated per (user, id, city) before they are shuffled, then
    per user, and the bound is applied to the users. Looking for the new users
    first, in the last days' partitions, would spare aggregating the others
    but needs the events themselves shuffled for the semi join as soon as new
    users are too many to broadcast.
    """
    since = hours_before(as_of, hours)
    latest = ms.latest_milestones(ev, specs, with_identity=True)
    kept = latest.filter(F.col(specs[0].column) >= since)
    kept = exclude_users(kept, excluded, "User_ID", "user_id")
    out = kept.select(
        F.col(USER).alias("User_Pseudo_ID"), "User_ID", "Location", *[m.column for m in specs]
    )
    return ms.format_cet(out, [m.column for m in specs])


def new_users_report(ev: DataFrame, as_of, excluded: DataFrame, hours: int = 24) -> DataFrame:
    """Published order: latest first_open first."""
    return new_users(ev, as_of, excluded, hours).orderBy(F.col("First_Open").desc_nulls_last(), "User_Pseudo_ID")


"""Time helpers: micros to instants, UTC days, CET text, ``as_of`` literals."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reports print civil time in zone "CET" as '%F %T'.
REPORT_ZONE = "CET"
REPORT_PATTERN = "yyyy-MM-dd HH:mm:ss"


def to_instant(micros: Column) -> Column:
    """INT64 microseconds since the epoch -> TIMESTAMP."""
    return F.timestamp_micros(micros)


def cet_text(ts: Column) -> Column:
    """TIMESTAMP -> 'yyyy-MM-dd HH:mm:ss' in CET (DST aware, sub-seconds dropped)."""
    return F.date_format(F.from_utc_timestamp(ts, REPORT_ZONE), REPORT_PATTERN)


def utc_day(ts: Column) -> Column:
    """UTC calendar date of an instant (session zone is pinned to UTC)."""
    return F.to_date(ts)


def parse_as_of(as_of) -> datetime:
    """Accept a datetime (naive = UTC) or ISO text; return an aware UTC datetime."""
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of.replace("Z", "+00:00"))
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    return as_of.astimezone(timezone.utc)


def as_of_lit(as_of) -> Column:
    """The evaluation time as a TIMESTAMP literal (replaces CURRENT_TIMESTAMP)."""
    return F.lit(parse_as_of(as_of))


def hours_before(as_of, hours: int) -> Column:
    """``as_of - INTERVAL hours HOUR`` as a literal (folded on the driver)."""
    return F.lit(parse_as_of(as_of) - timedelta(hours=hours))


def days_before(as_of, days: int) -> Column:
    """``DATE_SUB(DATE(as_of), INTERVAL days DAY)`` as a DATE literal."""
    return F.lit(parse_as_of(as_of).date() - timedelta(days=days))

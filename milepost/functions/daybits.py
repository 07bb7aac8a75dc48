"""Sets of UTC days as bitmaps of 64 days.

Day ``d`` (days since 1970-01-01) is bit ``d mod 64`` of block ``d div 64``.
Sets merge by bitwise OR, in any order and any number of times, so counting
distinct days needs one row per (user, block) instead of one per (user, day).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from milepost.functions.timefmt import utc_day

BLOCK_DAYS = 64
_EPOCH = date(1970, 1, 1).toordinal()


def day_number(ts: Column) -> Column:
    """Days since 1970-01-01 of the UTC day of an instant."""
    return F.unix_date(utc_day(ts))


def block_of(ts: Column) -> Column:
    """The block that holds the instant's UTC day."""
    return F.shiftright(day_number(ts), 6)


def bit_of(ts: Column) -> Column:
    """The instant's UTC day as a bitmap of its block."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), day_number(ts).bitwiseAND(63))


def count_days(bits: Column) -> Column:
    """Days in a bitmap; 0 for NULL (no day)."""
    return F.coalesce(F.bit_count(bits), F.lit(0)).cast("long")


def days_since(block: Column, bits: Column, first: date) -> Column:
    """The bitmap's days on or after ``first``."""
    number = first.toordinal() - _EPOCH
    kept = -1 << (number % BLOCK_DAYS)  # arithmetic: the low bits are cleared
    kept = (kept + 2**63) % 2**64 - 2**63
    return (
        F.when(block > number // BLOCK_DAYS, bits)
        .when(block == number // BLOCK_DAYS, bits.bitwiseAND(F.lit(kept).cast("long")))
        .otherwise(F.lit(0).cast("long"))
    )

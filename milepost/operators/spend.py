"""Spend monitor: latest bill, totals, per-app costs, severity, kill-switch
latch and alert rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from milepost.sources.documents import AMOUNT, RAW_AMOUNT

# Alert texts of the spend monitor.
HARD_TEXT = "`URGENT: CODE RED` Hard Threshold for a single day spent reached. Amount spent: %s. Hard Threshod limit is: %s"
SOFT_TEXT = "`ALERT`: Soft threshold reached. Current Amount spent: `$%s`. Soft threshold is set to: `$%s`"
SWITCH_OK_TEXT = "Kill switch activated for %s."
SWITCH_FAILED_TEXT = "UNABLE to ACTIVATE kill switch for %s."


def amount_columns(df: DataFrame, suffix: str = "Amount") -> list[str]:
    """Every column whose name ends with ``Amount`` (a new one joins the sum
    silently, as in the source); all must be numeric."""
    cols = [f for f in df.schema.fields if f.name.endswith(suffix)]
    bad = [f.name for f in cols if not isinstance(f.dataType, T.NumericType)]
    if bad:
        raise TypeError(f"non-numeric amount columns: {bad}")
    return [f.name for f in cols]


def latest_bill(bills: DataFrame, key: str = "provider", order: str = "time", tiebreak: str | None = None) -> DataFrame:
    """The newest record per provider, whatever its date.

    ``max_by`` over a struct of (time, tiebreak) is a partial aggregate, so a
    provider with most of the rows does not end up in one task. Ties on
    time keep the record with the smallest tiebreak (the first one listed).
    """
    cols = [c for c in bills.columns if c != key]
    tb = F.col(tiebreak) if tiebreak else F.lit(0)
    ordering = F.struct(F.col(order).alias("t"), (-tb).alias("tb")) if tiebreak else F.struct(F.col(order).alias("t"))
    latest = bills.groupBy(key).agg(F.max_by(F.struct(*cols), ordering).alias("_r"))
    return latest.select(key, "_r.*")


def bill_total(bills: DataFrame, keep=("provider", "time")) -> DataFrame:
    """Sum of all ``*Amount`` columns of each record, rounded once to DECIMAL(18,2).

    Decimals round half-up; the source summed binary doubles and rounded
    with Python's ``round``, which can differ by one cent (2.675 -> 2.67).
    """
    cols = amount_columns(bills)
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0).cast(RAW_AMOUNT)) for c in cols])
    return bills.select(*keep, F.round(total, 2).cast(AMOUNT).alias("total"))


def app_dollars(costs: DataFrame) -> DataFrame:
    """Per (app, day): cents -> dollars rounded to 2 places per app."""
    return costs.withColumn("dollars", F.round(F.col("cents") / 100, 2).cast(AMOUNT))


def spend_on(costs: DataFrame, days: list[str] | None = None) -> DataFrame:
    """Daily spend over all apps: the sum of per-app rounded dollars (a day
    missing for an app adds 0). With ``days`` (day texts, a parameter list)
    exactly those days are reported, 0 for a day without any entry."""
    totals = app_dollars(costs).groupBy("day").agg(F.sum("dollars").cast(AMOUNT).alias("total"))
    if days is None:
        return totals
    wanted = costs.sparkSession.createDataFrame([(d,) for d in days], "day string")
    out = wanted.join(totals, "day", "left")
    return out.select("day", F.coalesce(F.col("total"), F.lit(0).cast(AMOUNT)).alias("total"))


def missing_cost_days(apps: DataFrame, costs: DataFrame, first_day, last_day) -> DataFrame:
    """(app, day) for each app of the configured list and each day in [first_day,
    last_day] that has no cost entry: also for an app whose documents all failed,
    were empty or malformed, or never came. Days are generated per app row (no
    join with a day table) and removed by an anti join on (app, day)."""
    days = F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    wanted = apps.select("app").distinct().select("app", F.explode(F.transform(days, lambda d: F.date_format(d, "yyyy-MM-dd"))).alias("day"))
    present = costs.select("app", "day")
    return wanted.join(present, ["app", "day"], "left_anti")


def spend_by_project(costs: DataFrame, app_dim: DataFrame) -> DataFrame:
    """Daily spend per project: per-app rounded dollars joined to the app
    -> project dimension (AQE broadcasts it when it is small at run time)."""
    dim = app_dim.select("app", "project").distinct()
    rows = app_dollars(costs.select("app", "day", "cents")).join(dim, "app")
    return rows.groupBy("project", "day").agg(F.sum("dollars").cast(AMOUNT).alias("total"))


def severity(df: DataFrame, soft: float, hard: float, total: str = "total") -> DataFrame:
    """'hard' above the hard limit, else 'soft' above the soft limit, else
    'none'. Equal to a limit does not alert."""
    t = F.col(total)
    sev = F.when(t > F.lit(hard), F.lit("hard")).when(t > F.lit(soft), F.lit("soft")).otherwise(F.lit("none"))
    return df.withColumn("severity", sev)


def latch(
    df: DataFrame,
    ok_col: str = "switch_ok",
    key: str = "provider",
    order: str = "day",
    reset_by: str | None = None,
) -> DataFrame:
    """Kill-switch latch: on a hard row the switch is called (``activate``)
    until the first call that succeeded; afterwards never again (no reset,
    as in the source). ``reset_by`` (e.g. a day column when ``order`` is a
    poll time) starts a new latch for every value of that column.

    Equivalent to a running OR over earlier rows, but computed as the first
    successful hard row per key (a partial aggregate) joined back, so a key
    holding most rows is never sorted in one task.
    """
    hard = F.col("severity") == "hard"
    keys = [key] + ([reset_by] if reset_by else [])
    first_ok = df.groupBy(*keys).agg(F.min(F.when(hard & F.col(ok_col), F.col(order))).alias("_first_ok"))
    first_ok = first_ok.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    # NULL-safe: records without a provider share a latch, as in the window form.
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(first_ok[f"_of_{k}"]) for k in keys])
    joined = df.join(first_ok, same, "left").drop(*(f"_of_{k}" for k in keys))
    activate = hard & (F.col("_first_ok").isNull() | (F.col(order) <= F.col("_first_ok")))
    return joined.withColumn("activate", activate).drop("_first_ok")


def latch_window(df: DataFrame, ok_col: str = "switch_ok", key: str = "provider", order: str = "day") -> DataFrame:
    """The same latch as a running window (reference formulation; used by
    tests to check :func:`latch`)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    hard = F.col("severity") == "hard"
    before = F.coalesce(F.max(hard & F.col(ok_col)).over(w), F.lit(False))
    return df.withColumn("activate", hard & ~before)


def _fmt_limit(x: float) -> str:
    return str(float(x))


def spend_alerts(
    latched: DataFrame, soft: float, hard: float, source_prefix: str = "spend", dedup: bool = False, time_col: str = "day"
) -> DataFrame:
    """Alert rows (alert_time, source, severity, message): one per hard or
    soft row (repeated on every poll while over the limit, as in the source)
    and one per switch call with its outcome. ``dedup=True`` keeps one
    threshold alert per (provider, UTC day, severity) for per-poll input."""
    t = F.col(time_col).cast("timestamp")
    source = F.concat(F.lit(source_prefix + ":"), F.coalesce("provider", F.lit("unknown")))
    amount = F.col("total").cast("string")
    over = F.col("severity") != "none"
    if dedup:
        # The first row over the limit per (provider, UTC day, severity).
        first = latched.filter(over).groupBy("provider", F.to_date(t).alias("_d"), "severity").agg(F.min(t).alias("_t"))
        first = first.select(F.col("provider").alias("_p"), F.col("severity").alias("_s"), "_t").withColumn("_first", F.lit(True))
        same = latched["provider"].eqNullSafe(first["_p"]) & (latched["severity"] == first["_s"]) & (t == first["_t"])
        latched = latched.join(first, same, "left")
        twice = Window.partitionBy("provider", time_col, "severity").orderBy("total", "activate")
        over = over & F.col("_first") & (F.row_number().over(twice) == 1)
    # Both alerts of a row from one pass over the latched rows.
    threshold = F.when(F.col("severity") == "hard", F.format_string(HARD_TEXT, amount, F.lit(_fmt_limit(hard)))).otherwise(
        F.format_string(SOFT_TEXT, amount, F.lit(_fmt_limit(soft)))
    )
    switch = F.when(F.col("switch_ok"), F.format_string(SWITCH_OK_TEXT, F.col("provider"))).otherwise(
        F.format_string(SWITCH_FAILED_TEXT, F.col("provider"))
    )
    alerts = F.array(
        F.when(F.col("_over"), F.struct(F.col("severity").alias("severity"), threshold.alias("message"))),
        F.when(F.col("activate"), F.struct(F.lit("hard").alias("severity"), switch.alias("message"))),
    )
    rows = latched.withColumn("_over", over).select(
        t.alias("alert_time"), source.alias("source"), F.explode(F.array_compact(alerts)).alias("_a")
    )
    return rows.select("alert_time", "source", "_a.severity", "_a.message")

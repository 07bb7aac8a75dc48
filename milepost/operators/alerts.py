"""One alert table for all monitors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALERT_COLUMNS = ["alert_time", "source", "severity", "message"]


def alerts_table(*dfs: DataFrame) -> DataFrame:
    """Union of alert rows (alert_time, source, severity, message)."""
    parts = [d.select(F.col("alert_time").cast("timestamp"), *ALERT_COLUMNS[1:]) for d in dfs]
    return reduce(lambda a, b: a.unionByName(b), parts)


def worker_alert_rows(alerts: DataFrame, time_col: str = "snapshot_time", by: str = "snapshot_id") -> DataFrame:
    """Worker-threshold alerts in the common alert layout."""
    return alerts.select(
        F.col(time_col).alias("alert_time"),
        F.concat(F.lit("workers:"), F.col(by).cast("string")).alias("source"),
        F.lit("critical").alias("severity"),
        F.col("message"),
    )

"""Event parameters as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_params(ev: DataFrame, keep=("user_pseudo_id", "event_name", "event_timestamp", "event_id")) -> DataFrame:
    """One row per event parameter: (keep..., param_key, param_value).

    An inner explode, as the source's comma join with UNNEST: events whose
    parameter array is empty or NULL produce no row.
    """
    rows = ev.select(*keep, F.explode("event_params").alias("_p"))
    return rows.select(*keep, F.col("_p.key").alias("param_key"), F.col("_p.value.string_value").alias("param_value"))

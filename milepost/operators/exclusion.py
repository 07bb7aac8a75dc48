"""NULL-safe exclusion of listed users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exclude_users(df: DataFrame, listed: DataFrame, col: str, list_col: str | None = None) -> DataFrame:
    """Keep rows whose ``col`` is NULL or not in ``listed``.

    The list is data, not an IN literal. A left anti join keeps NULL keys
    (they never match), which is what ``col IS NULL OR col NOT IN (...)``
    does for a list without NULLs; NULLs are removed from the list so the
    two stay equal. AQE broadcasts the list when it is small at run time.
    """
    list_col = list_col or col
    keys = listed.select(F.col(list_col).alias("_excluded")).filter(F.col("_excluded").isNotNull()).distinct()
    return df.join(keys, df[col] == keys["_excluded"], "left_anti")

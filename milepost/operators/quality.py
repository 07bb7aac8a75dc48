"""Input checks: required fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_fields(df: DataFrame, cols: list[str], id_col: str = "id") -> DataFrame:
    """Rows with required fields that are NULL or blank after trimming:
    (id, missing) where ``missing`` lists the field names, ', '-joined."""
    names = [F.when(F.col(c).isNull() | (F.trim(F.col(c)) == ""), F.lit(c)) for c in cols]
    out = df.select(F.col(id_col).alias("id"), F.concat_ws(", ", *names).alias("missing"))
    return out.filter(F.col("missing") != "")

"""Report sinks: timestamped distributed export and materialisation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from milepost.functions.timefmt import parse_as_of

# Report file name stamp "<Report>_%Y-%m-%d_%H-%M".
STAMP = "%Y-%m-%d_%H-%M"


def report_name(name: str, as_of) -> str:
    """``<name>_YYYY-MM-DD_HH-MM`` of the evaluation time (UTC)."""
    return f"{name}_{parse_as_of(as_of).strftime(STAMP)}"


def write_report(df: DataFrame, base: str, name: str, as_of, fmt: str = "parquet", order_by=None) -> str:
    """Write a report under a timestamped folder; never overwrite.

    Files are written by the executors in parallel (no driver-side
    spreadsheet). When ``order_by`` is given the rows are range-partitioned
    and sorted, so part files concatenated in name order give the report's
    order; sorting happens here once, not inside the report plan.
    """
    path = f"{base.rstrip('/')}/{report_name(name, as_of)}"
    out = df.orderBy(*order_by) if order_by else df
    writer = out.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return path


def materialize(df: DataFrame, view: str, table: str | None = None) -> DataFrame:
    """Make a result addressable by name and re-open it lazily.

    With ``table`` the rows are stored (``saveAsTable``, lineage cut, the
    result survives lost executors); without it a temporary view is
    registered. Either way the returned DataFrame reads by name.
    """
    spark = df.sparkSession
    if table:
        df.write.mode("overwrite").saveAsTable(table)
        spark.table(table).createOrReplaceTempView(view)
    else:
        df.createOrReplaceTempView(view)
    return spark.table(view)

"""Event table: schema, narrow read schemas, loader with partition pruning."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from milepost.session import ensure_utc

PARAM = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StructType([T.StructField("string_value", T.StringType())])),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("user_pseudo_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("event_timestamp", T.LongType()),
        T.StructField("geo", T.StructType([T.StructField("city", T.StringType())])),
        T.StructField("event_params", T.ArrayType(PARAM)),
        T.StructField("event_id", T.LongType()),
        T.StructField("event_date", T.DateType()),
    ]
)


def narrow_schema(columns: list[str]) -> T.StructType:
    """Read schema with only the listed top-level columns.

    Spark prunes top-level columns and plain nested fields by itself, but
    with ``explode``/``filter`` over ``event_params`` it still reads unused
    leaves; passing the narrow schema to the reader keeps scans minimal.
    """
    keep = set(columns)
    return T.StructType([f for f in EVENT_SCHEMA.fields if f.name in keep])


def load_events(
    spark: SparkSession,
    path: str,
    date_from: date | str | None = None,
    date_to: date | str | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Read a date-partitioned (``event_date=...``) Parquet event table.

    Without bounds every partition is read, as the source report's wildcard
    table did. Bounds become partition filters (pruned before any file is
    opened).
    """
    ensure_utc(spark)
    schema = narrow_schema(columns + ["event_date"]) if columns else EVENT_SCHEMA
    df = spark.read.schema(schema).option("basePath", path).parquet(path)
    if date_from is not None:
        df = df.filter(F.col("event_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        df = df.filter(F.col("event_date") <= F.lit(date_to).cast("date"))
    return df


#: Rows of a Parquet page; a page is the least that a family scan can skip.
PAGE_ROWS = 20_000


def event_class(name: Column) -> Column:
    """The first word of an event name ('receive', 'open', 'onboarding', ...):
    what all names of a family's prefix share."""
    return F.substring_index(name, "_", 1)


def write_events(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    partitions: int | None = None,
    page_rows: int = PAGE_ROWS,
    lookup: tuple[str, ...] = ("user_pseudo_id",),
) -> None:
    """Store events partitioned by UTC day. Inside files events lie by class of
    their name and then by user, so that a scan for some families, whose prefix
    filters reach Parquet, skips the row groups and pages of other classes by
    their statistics. Columns in ``lookup`` get Bloom filters, for scans that ask
    for some users.

    Range partitioning on day, user, time and id samples the keys, so a day, or
    a user's day, that holds a large share of all events is split over several
    writer tasks, and each writes few, large files. Without an explicit
    ``partitions`` count AQE merges small ranges.
    """
    keys = ("event_date", "user_pseudo_id", "event_timestamp", "event_id")
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)  # AQE sizes the ranges
    writer = (
        ranged.sortWithinPartitions("event_date", event_class(F.col("event_name")), "user_pseudo_id", "event_timestamp")
        .write.mode(mode)
        .option("parquet.page.row.count.limit", page_rows)
        .partitionBy("event_date")
    )
    for column in lookup:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)

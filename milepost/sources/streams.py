"""Streaming sources over Parquet folders/globs (schema from the footer)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from milepost.session import ensure_utc


def parquet_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over ``path`` (a folder or a glob). The schema is taken
    from the existing files once, as streaming sources need it up front."""
    ensure_utc(spark)
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One driver table (``<table>.parquet``) as a file stream."""
    return parquet_stream(spark, f"{sf_dir.rstrip('/')}/{table}.parquet*")

"""Log files -> records, also of several lines.

A record begins with a line ``time - logger - LEVEL - message``; the lines after
it up to the next such line (a traceback, say) belong to its message. Files are
read in splits, and a record may go on in the next ones: each task puts the lines
of its splits together in order, and only what lies at the splits' edges (the
last record of a split, and lines before its first) is brought together by file
and offset. Nothing is dropped: lines before a file's first record, and records
whose time is none, come out as rejects.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from milepost.session import ship_package
from milepost.sources.documents import LOG_PATTERN

#: The beginning of a record's first line; its level and time are checked later.
HEADER = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d - .*? - [A-Z]+ - "

RECORD, NO_HEADER, BAD_TIME = "record", "no_header", "bad_time"

_PARTS = "file string, offset long, nth long, head boolean, edge boolean, text string, lines long"


def _parts(lines: DataFrame) -> DataFrame:
    """Per split (file, offset): its records in order, and first the lines that
    belong to a record before it (``head`` false). ``edge``: not complete for sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int] | None = None
        nth, head, held = 0, False, []

        def part(last: bool) -> tuple:
            return (*at, nth, head, last or not head, "\n".join(held), len(held))

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.int64())
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            names = ["file", "offset", "nth", "head", "edge", "text", "lines"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for b in batches:
            out = []
            begins = pc.match_substring_regex(b.column("value"), HEADER).to_pylist()
            columns = (b.column(c).to_pylist() for c in ("file", "offset", "value"))
            for file, offset, value, begin in zip(*columns, begins):
                if (file, offset) != at:
                    if held:
                        out.append(part(True))
                    at, nth, head, held = (file, offset), 0, begin, [value]
                elif begin:
                    out.append(part(False))
                    nth, head, held = nth + 1, True, [value]
                else:
                    held.append(value)
            yield table(out)
        yield table([part(True)] if held else [])

    ship_package(lines.sparkSession)
    return lines.mapInArrow(run, _PARTS)


def assembled(lines: DataFrame) -> DataFrame:
    """(file, offset, nth, head, text, lines): whole records, and one row for the
    lines before a file's first record. ``lines``: (file, offset, value), each
    split's in order."""
    parts = _parts(lines)
    whole = parts.filter("not edge").select("file", "offset", "nth", "head", "text", "lines")
    # At most two rows of each split: lines before its first record, and its last one.
    edges = parts.filter("edge")
    before = Window.partitionBy("file").orderBy("offset", "nth").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("head"), F.struct("offset", "nth")), ignorenulls=True).over(before)
    pieces = F.array_sort(F.collect_list(F.struct("offset", "nth", "head", "text", "lines")))
    met = (
        edges.withColumn("owner", owner)
        .groupBy("file", "owner")
        .agg(pieces.alias("p"))
        .select(
            "file",
            F.col("p")[0]["offset"].alias("offset"),
            F.col("p")[0]["nth"].alias("nth"),
            F.col("p")[0]["head"].alias("head"),
            F.array_join(F.col("p.text"), "\n").alias("text"),
            F.aggregate("p.lines", F.lit(0).cast("long"), lambda a, x: a + x).alias("lines"),
        )
    )
    return whole.unionByName(met)


def parse_records(records: DataFrame) -> DataFrame:
    """Assembled records -> (file, offset, status, ts, logger, level, message,
    lines). ``offset`` is that of the split in which the record begins. Rejects
    have their text as message and no ts, logger and level."""
    first = F.substring_index("text", "\n", 1)
    rest = F.substring("text", F.char_length(first) + 1, F.char_length("text"))
    parsed = records.withColumn("_first", first).withColumn("_rest", rest)
    ts = F.try_to_timestamp(F.regexp_extract("_first", LOG_PATTERN, 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    status = F.when(~F.col("head"), NO_HEADER).when(ts.isNull(), BAD_TIME).otherwise(RECORD)
    found = F.col("status") == RECORD
    return parsed.withColumn("status", status).select(
        "file",
        "offset",
        "status",
        F.when(found, ts).alias("ts"),
        *[F.when(found, F.regexp_extract("_first", LOG_PATTERN, i)).alias(c) for i, c in ((2, "logger"), (3, "level"))],
        F.when(found, F.concat(F.regexp_extract("_first", LOG_PATTERN, 4), "_rest")).otherwise(F.col("text")).alias("message"),
        "lines",
    )


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """Records and rejects of the log files under ``path``."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"), "value"
    )
    return parse_records(assembled(lines))


def level_counts(records: DataFrame) -> DataFrame:
    """(day, level, status, records, lines): what was logged, and what was not readable."""
    return records.groupBy(F.to_date("ts").alias("day"), "level", "status").agg(
        F.count(F.lit(1)).alias("records"), F.sum("lines").alias("lines")
    )

"""Windowed aggregates kept by ``foreachBatch``: open windows in one small
table, closed ones moved to a final table once, late rows in a side table.

A batch takes the watermark that the batches before it reached (newest event
time less ``lateness``). Rows of windows that end at or before it are late: they
change no total and go to ``late``. All others are aggregated and merged with
the open windows; windows that end at or before the watermark can't change any
more and are written with ``closed=true``, the rest with ``closed=false``. Only
the last batch's open windows are live, so a read opens the closed windows'
files and one small folder, however many batches ran.

    state/batch=<id>/closed=true|false   windows
    state/batch=<id>/closed=late         what late rows would have added to theirs
    late/batch=<id>                      late rows themselves, only if there are some
    control/<id>.json                    watermark and counts, written last

A batch reads only what the one before it wrote, so a retried batch writes the
same. Rows without a time are in no window and are left out.

:func:`without_redelivered` drops rows that are delivered again, by their ids.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from milepost.storage import Folder
from milepost.streaming.runner import run_query

BATCH, CLOSED, END = "batch", "closed", "window_end"


@dataclass(frozen=True)
class WindowSpec:
    """What is aggregated: ``start`` and ``end`` of a row's window, the other
    grouping columns, aggregates of rows, and how each merges."""

    time: str
    start: Column
    end: Column
    keys: tuple[str, ...]
    partials: dict[str, Column]
    lateness: str
    merge: dict[str, Callable[[str], Column]] = field(default_factory=dict)  # sum, if not named


def tumbling(time: str, width: str) -> tuple[Column, Column]:
    """Start and end of the tumbling window of a time column."""
    w = F.window(F.col(time), width)
    return w["start"], w["end"]


def aggregated(rows: DataFrame, spec: WindowSpec) -> DataFrame:
    """The windows of a table: the batch twin of the stream."""
    # F.window must be evaluated by itself before its fields are grouped by.
    placed = rows.withColumns({"window_start": spec.start, END: spec.end})
    return placed.groupBy("window_start", END, *spec.keys).agg(*[c.alias(n) for n, c in spec.partials.items()])


def merged(parts: DataFrame, spec: WindowSpec, by: list[str]) -> DataFrame:
    how = {n: spec.merge.get(n, F.sum) for n in spec.partials}
    kinds = {f.name: f.dataType for f in parts.schema.fields}
    return parts.groupBy(*by).agg(*[f(n).cast(kinds[n]).alias(n) for n, f in how.items()])


def instant(seconds: float) -> Column:
    return F.lit(datetime.fromtimestamp(seconds, timezone.utc))


class WindowTables:
    """What a windowed stream has written below ``base``."""

    def __init__(self, spark: SparkSession, base: str, spec: WindowSpec, rows: T.StructType):
        self.spark, self.base, self.spec = spark, base, spec
        self.files = Folder(spark, base)
        self.row_schema = rows
        self.schema = aggregated(spark.createDataFrame([], rows), spec).schema

    def control(self, upto: int | None = None) -> dict:
        """What the last batch (before ``upto``) left: its id, the watermark
        (epoch seconds) and the counts so far."""
        ids = [int(n.split(".")[0]) for n in self.files.names("control") if n.endswith(".json") and not n.startswith(".")]
        ids = [i for i in ids if upto is None or i < upto]
        start = {"batch": -1, "watermark": None, "rows": 0, "late": 0}
        return json.loads(self.files.read(f"control/{max(ids):012d}.json")) if ids else start

    def _read(self, paths: list[str], schema: T.StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/{p}" for p in paths])

    def open_windows(self, batch: int) -> DataFrame:
        path = f"state/{BATCH}={batch}/{CLOSED}=false"
        return self._read([path] if self.files.names(path) else [], self.schema)

    def closed_windows(self) -> DataFrame:
        last = self.control()["batch"]
        batches = [n for n in self.files.names("state") if int(n.split("=")[1]) <= last]
        paths = [f"state/{b}/{CLOSED}=true" for b in batches]
        return self._read([p for p in paths if self.files.names(p)], self.schema)

    def windows(self) -> DataFrame:
        """Every window's current values, closed or open."""
        return self.closed_windows().unionAll(self.open_windows(self.control()["batch"]))

    def late_rows(self) -> DataFrame:
        """The rows that came after their window was closed."""
        return self._read([f"late/{n}" for n in self.files.names("late")], self.row_schema)

    def late_windows(self) -> DataFrame:
        """The aggregates of the late rows, by window."""
        paths = [f"state/{b}/{CLOSED}=late" for b in self.files.names("state")]
        return self._read([p for p in paths if self.files.names(p)], self.schema)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Take one micro-batch."""
        spec, before = self.spec, self.control(upto=batch_id)
        mark = before["watermark"]
        seen = Observation()
        placed = batch.withColumns({"window_start": spec.start, END: spec.end})
        if mark is None:
            late = F.lit(False)
        else:
            late = F.coalesce(F.col(END) <= instant(mark), F.lit(False))
        flagged = placed.withColumn("_late", late).observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.count_if("_late").alias("late"),
            F.max(F.unix_micros(F.col(spec.time)) - _micros(spec.lateness)).alias("mark"),
        )
        # Late rows stay a group of their own: were they filtered out here, a
        # batch of late rows only would be planned as empty and not observed.
        by = ["window_start", END, *spec.keys, "_late"]
        parts = flagged.groupBy(*by).agg(*[c.alias(n) for n, c in spec.partials.items()])
        held = self.open_windows(before["batch"]).withColumn("_late", F.lit(False))
        windows = merged(held.unionByName(parts), spec, by)
        done = F.lit(False) if mark is None else F.coalesce(F.col(END) <= instant(mark), F.lit(False))
        kind = F.when(F.col("_late"), "late").when(done, "true").otherwise("false")
        path = f"{self.base}/state/{BATCH}={batch_id}"
        windows.withColumn(CLOSED, kind).drop("_late").write.mode("overwrite").partitionBy(CLOSED).parquet(path)
        counts = {"rows": 0, "late": 0, "mark": None} if batch.isEmpty() else seen.get
        if counts["late"]:
            rows = placed.filter(late).select(*self.row_schema.names)
            rows.write.mode("overwrite").parquet(f"{self.base}/late/{BATCH}={batch_id}")
        reached = [m for m in (mark, None if counts["mark"] is None else counts["mark"] / 1e6) if m is not None]
        after = {
            "batch": batch_id,
            "watermark": max(reached, default=None),
            "rows": before["rows"] + counts["rows"],
            "late": before["late"] + counts["late"],
        }
        self.files.write_new(f"control/{batch_id:012d}.json", json.dumps(after), replace=True)
        self._clean(batch_id)

    def _clean(self, batch_id: int) -> None:
        """Drop what no batch and no reader opens any more: open windows and
        control files of the batches before the last but one."""
        for name in self.files.names("state"):
            if int(name.split("=")[1]) < batch_id - 1:
                self.files.delete(f"state/{name}/{CLOSED}=false")
                if not any(n.startswith(CLOSED) for n in self.files.names(f"state/{name}")):
                    self.files.delete(f"state/{name}")
        for name in self.files.names("control"):
            if name.endswith(".json") and int(name.split(".")[0]) < batch_id - 1:
                self.files.delete(f"control/{name}")


def _micros(interval: str) -> Column:
    """Length of an interval of days or less ('2 hours') in microseconds."""
    zero = F.lit(datetime(1970, 1, 1, tzinfo=timezone.utc))
    return F.unix_micros(zero + F.expr(f"INTERVAL {interval}"))


def without_redelivered(rows: DataFrame, time: str, ids: tuple[str, ...], horizon: str = "7 days") -> DataFrame:
    """A stream's rows, each id once. State holds the ids of ``horizon`` behind
    the newest event time; rows older than that are dropped as Spark drops late
    rows, so it should exceed the lateness of what follows."""
    return rows.withWatermark(time, horizon).dropDuplicatesWithinWatermark(list(ids)) if ids else rows


def run_windows(
    spark: SparkSession, rows: DataFrame, spec: WindowSpec, name: str, state_partitions: int | None = None
) -> WindowTables:
    """Run a stream of rows to the end of its input; return its tables."""

    def sink(base: str) -> Callable[[DataFrame, int], None]:
        def write(batch: DataFrame, batch_id: int) -> None:
            WindowTables(batch.sparkSession, base, spec, batch.schema).write(batch, batch_id)

        return write

    base = run_query(spark, rows, name, "append", sink, state_partitions)
    return WindowTables(spark, base, spec, rows.schema)

"""Monitors as Structured Streaming jobs (T1-T5).

Every job is a streaming DataFrame plan plus a runner; each has a batch
twin in :mod:`milepost.operators` and, after ``availableNow`` has consumed
all input, returns the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from milepost.functions.families import EventFamily
from milepost.operators import availability as av
from milepost.operators import fleet as fl
from milepost.operators import milestones as ms
from milepost.operators import spend as sp
from milepost.operators.milestones import USER
from milepost.sources.documents import AMOUNT
from milepost.storage import Folder
from milepost.streaming.runner import BATCH, CompactedLog, run_query
from milepost.streaming.windows import WindowSpec, WindowTables, aggregated, run_windows, tumbling, without_redelivered


# ---------------------------------------------------------------- T1 spend
def daily_spend_spec(lateness: str = "2 days") -> WindowSpec:
    """Spend rows (provider, ts, amount) -> totals per provider and UTC day."""
    return WindowSpec(
        "ts", *tumbling("ts", "1 day"), ("provider",), {"total": F.sum("amount").cast(AMOUNT)}, lateness
    )


def daily_spend(windows: DataFrame, soft: float, hard: float) -> DataFrame:
    """Daily windows -> (provider, day, total, severity)."""
    return sp.severity(windows.select("provider", F.to_date("window_start").alias("day"), "total"), soft, hard)


def daily_spend_tables(
    spark: SparkSession, spend_rows: DataFrame, lateness: str = "2 days", ids: tuple[str, ...] = ()
) -> WindowTables:
    """Run the spend stream; totals, late rows and counts are in the tables.
    ``ids``: columns by which a row that is delivered again is known."""
    rows = without_redelivered(spend_rows, "ts", ids)
    return run_windows(spark, rows, daily_spend_spec(lateness), "stream-daily-spend")


def run_daily_spend(
    spark: SparkSession, spend_rows: DataFrame, soft: float, hard: float, lateness: str = "2 days", ids: tuple[str, ...] = ()
) -> DataFrame:
    return daily_spend(daily_spend_tables(spark, spend_rows, lateness, ids).windows(), soft, hard)


# ---------------------------------------------------------------- T2 latch
LATCH_OUT = T.StructType(
    [
        T.StructField("provider", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("severity", T.StringType()),
        T.StructField("activate", T.BooleanType()),
    ]
)
_DECIDED = T.StructType([*LATCH_OUT.fields, T.StructField("version", T.LongType())])
_FIRST_OK = T.StructType([T.StructField("provider", T.StringType()), T.StructField("first_ok", T.DateType())])


class LatchTables:
    """The latch over daily rows that come in any order.

    ``first`` holds each provider's earliest day with a successful switch call:
    a minimum, so it merges whatever comes when. A row is decided by the minimum
    of its time; if an earlier success comes later, the decisions after it are
    taken back: written again, for the same provider and day, as not activated.
    ``active`` holds the decisions that can still be taken back (hard days up to
    the first success). The latest version of each (provider, day) is the result,
    equal to :func:`milepost.operators.spend.latch` over all rows so far.

    A (provider, day) that is delivered again replaces its row; a success, once
    seen, stays.
    """

    def __init__(self, spark: SparkSession, base: str, every: int = 8):
        self.spark, self.base = spark, base
        self.files = Folder(spark, base)
        self.log = CompactedLog(spark, f"{base}/decisions", _DECIDED, self._latest, every)

    @staticmethod
    def _latest(parts: DataFrame) -> DataFrame:
        last = F.max_by(F.struct("severity", "activate", "version"), "version")
        return parts.groupBy("provider", "day").agg(last.alias("r")).select("provider", "day", "r.*")

    def _last(self, name: str, batch_id: int, schema: T.StructType) -> DataFrame:
        """A table as the batch before left it."""
        ids = [int(n.split("=")[1]) for n in self.files.names(name)]
        before = max((i for i in ids if i < batch_id), default=None)
        if before is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}/{BATCH}={before}")

    def _replace(self, name: str, df: DataFrame, batch_id: int) -> DataFrame:
        path = f"{self.base}/{name}/{BATCH}={batch_id}"
        df.write.mode("overwrite").parquet(path)
        for n in self.files.names(name):
            if int(n.split("=")[1]) < batch_id - 1:
                self.files.delete(f"{name}/{n}")
        return self.spark.read.schema(df.schema).parquet(path)

    def write(self, daily: DataFrame, batch_id: int) -> None:
        """Take one micro-batch of (provider, day, severity, switch_ok)."""
        daily = daily.persist()  # read by three writes
        hard = F.col("severity") == "hard"
        ok_day = F.when(hard & F.col("switch_ok"), F.col("day"))
        found = daily.groupBy("provider").agg(F.min(ok_day).alias("first_ok")).filter("first_ok is not null")
        both = self._last("first", batch_id, _FIRST_OK).unionByName(found)
        first = self._replace("first", both.groupBy("provider").agg(F.min("first_ok").alias("first_ok")), batch_id)

        def decided(rows: DataFrame) -> DataFrame:
            of = first.withColumnRenamed("provider", "_of")
            joined = rows.join(of, rows["provider"].eqNullSafe(of["_of"]), "left").drop("_of")
            still = F.col("first_ok").isNull() | (F.col("day") <= F.col("first_ok"))
            return joined.withColumn("activate", hard & still).select(*LATCH_OUT.names)

        held = self._last("active", batch_id, LATCH_OUT)
        again = daily.select(F.col("provider").alias("_p"), F.col("day").alias("_d")).distinct()
        held = held.join(again, held["provider"].eqNullSafe(again["_p"]) & (held["day"] == again["_d"]), "left_anti")
        new, kept = decided(daily), decided(held)
        self.log.append(
            new.unionByName(kept.filter(~F.col("activate"))).withColumn("version", F.lit(batch_id).cast("long")), batch_id
        )
        self._replace("active", new.unionByName(kept).filter("activate"), batch_id)
        daily.unpersist()

    def decisions(self) -> DataFrame:
        return self.log.read().select(*LATCH_OUT.names)


def run_latch(spark: SparkSession, daily: DataFrame, compact_every: int = 8) -> DataFrame:
    """Daily severity rows (provider, day, severity, switch_ok), in any order ->
    latch decisions."""

    def sink(base: str) -> Callable[[DataFrame, int], None]:
        return lambda batch, batch_id: LatchTables(batch.sparkSession, base, compact_every).write(batch, batch_id)

    base = run_query(spark, daily, "stream-latch", "append", sink)
    return LatchTables(spark, base, compact_every).decisions()


# --------------------------------------------------------- T3 availability
def availability_spec(window: str = "1 hour", lateness: str = "2 hours") -> WindowSpec:
    """Classified probes -> probes and failures per (window, provider, task)."""
    counts = {"probes": F.count(F.lit(1)), "failures": F.count_if(~F.col("ok"))}
    return WindowSpec("ts", *tumbling("ts", window), ("provider", "task"), counts, lateness)


def availability_windows(classified: DataFrame, window: str = "1 hour") -> DataFrame:
    """The batch twin: (window_start, provider, task, probes, failures)."""
    return aggregated(classified, availability_spec(window)).drop("window_end")


def availability_tables(
    spark: SparkSession,
    probes: DataFrame,
    window: str = "1 hour",
    lateness: str = "2 hours",
    ids: tuple[str, ...] = (),
    rules: dict[str, str] = {},
) -> WindowTables:
    """Run the availability stream over recorded probes. ``ids``: columns by
    which a probe that is delivered again is known; ``rules``: the success rules
    of :func:`milepost.operators.availability.classify`."""
    rows = av.classify(without_redelivered(probes, "ts", ids), rules)
    return run_windows(spark, rows, availability_spec(window, lateness), "stream-availability")


def run_availability(
    spark: SparkSession,
    probes: DataFrame,
    window: str = "1 hour",
    lateness: str = "2 hours",
    ids: tuple[str, ...] = (),
    rules: dict[str, str] = {},
) -> DataFrame:
    return availability_tables(spark, probes, window, lateness, ids, rules).windows().drop("window_end")


# -------------------------------------------------------------- T4 workers
#: An endpoint of a snapshot that is delivered again is known by these.
SNAPSHOT_ROW = (*fl.SNAPSHOT, "id")


def worker_spec(lateness: str = "1 hour") -> WindowSpec:
    """Endpoint rows of inventory snapshots -> totals per snapshot, which is a
    window of its own time only."""
    at = F.col("snapshot_time")
    totals = {
        "endpoints": F.count(F.lit(1)),
        "workers": F.sum(F.coalesce(F.col("workersMin"), F.lit(0))).cast("long"),
    }
    return WindowSpec("snapshot_time", at, at, ("snapshot_id",), totals, lateness)


def worker_tables(
    spark: SparkSession, endpoint_rows: DataFrame, lateness: str = "1 hour", ids: tuple[str, ...] = SNAPSHOT_ROW
) -> WindowTables:
    rows = without_redelivered(endpoint_rows, "snapshot_time", ids, "1 day")
    return run_windows(spark, rows, worker_spec(lateness), "stream-workers")


def run_workers(
    spark: SparkSession, endpoint_rows: DataFrame, limit: int, lateness: str = "1 hour", ids: tuple[str, ...] = SNAPSHOT_ROW
) -> DataFrame:
    totals = worker_tables(spark, endpoint_rows, lateness, ids).windows()
    return fl.worker_alerts(totals.withColumnRenamed("window_start", "snapshot_time"), limit)


# ----------------------------------------------------------- T5 milestones
def milestone_partials(ev: DataFrame, specs) -> DataFrame:
    """Per user: first and latest time of each spec (mergeable partials)."""
    name = F.col("event_name")
    ts = ms.event_time()
    aggs = []
    for m in specs:
        cond = m.predicate(name)
        aggs += [F.min(F.when(cond, ts)).alias(f"{m.column}_first"), F.max(F.when(cond, ts)).alias(f"{m.column}_latest")]
    return ev.groupBy(USER).agg(*aggs)


def merge_partials(parts: DataFrame, specs) -> DataFrame:
    """Merge milestone partials of several batches (MIN of firsts, MAX of
    latests) into one row per user."""
    return parts.groupBy(USER).agg(
        *[
            agg(f"{m.column}_{suffix}").alias(f"{m.column}_{suffix}")
            for m in specs
            for suffix, agg in (("first", F.min), ("latest", F.max))
        ]
    )


def run_milestones(spark: SparkSession, events: DataFrame, specs, compact_every: int = 8) -> DataFrame:
    """Each micro-batch is aggregated on its own and added to a compacted log
    of partials (no state store); the result merges them with MIN/MAX."""
    schema = milestone_partials(events, specs).schema

    def log(session: SparkSession, base: str) -> CompactedLog:
        return CompactedLog(session, base, schema, lambda parts: merge_partials(parts, specs), compact_every)

    def sink(base: str) -> Callable[[DataFrame, int], None]:
        return lambda batch, i: log(batch.sparkSession, base).append(milestone_partials(batch, specs), i)

    base = run_query(spark, events, "stream-milestones", "append", sink)
    cols = [f"{m.column}_{s}" for m in specs for s in ("first", "latest")]
    return ms.format_cet(log(spark, base).read(), cols)


# ------------------------------------------------- T5 n-th milestones (W1-W3)
NTH_PARTIAL = T.StructType(
    [
        T.StructField(USER, T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("event_timestamp", T.LongType()),
        T.StructField("event_id", T.LongType()),
    ]
)


def first_of_families(ev: DataFrame, families: list[EventFamily], size: int) -> DataFrame:
    """The first ``size`` events per (user, family): partials of the n-th ones
    for n up to ``size``, since an event that isn't among the first ``size`` of
    its part has as many before it."""
    tags = F.array_compact(F.array(*[F.when(f.predicate(), F.lit(f.name)) for f in families]))
    some = reduce(lambda a, b: a | b, [f.prefilter() for f in families])
    rows = ev.filter(some).select(USER, F.explode(tags).alias("family"), "event_timestamp", "event_id")
    return smallest(rows, size)


def smallest(parts: DataFrame, size: int) -> DataFrame:
    """Merge such partials: the first ``size`` of all. An event that comes again
    (same time and id) counts once."""
    w = Window.partitionBy(USER, "family").orderBy("event_timestamp", "event_id")
    once = parts.dropDuplicates(NTH_PARTIAL.names)
    return once.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= size).drop("_rn")


def nth_of_partials(parts: DataFrame, wanted: list[tuple[EventFamily, int, str]]) -> DataFrame:
    """One row per user with a family event; a column per n-th event."""
    w = Window.partitionBy(USER, "family").orderBy("event_timestamp", "event_id")
    ranked = parts.withColumn("_rn", F.row_number().over(w))
    at = [F.max(F.when((F.col("family") == f.name) & (F.col("_rn") == n), ms.event_time())).alias(c) for f, n, c in wanted]
    return ms.format_cet(ranked.groupBy(USER).agg(*at), [c for _, _, c in wanted])


def run_nth_milestones(
    spark: SparkSession, events: DataFrame, wanted: list[tuple[EventFamily, int, str]], compact_every: int = 8
) -> DataFrame:
    """The n-th event of each family per user, kept by a stream: equal to
    :func:`milepost.operators.milestones.nth_events` however the events are
    split into batches."""
    families = list({f.name: f for f, _, _ in wanted}.values())
    size = max(n for _, n, _ in wanted)

    def log(session: SparkSession, base: str) -> CompactedLog:
        return CompactedLog(session, base, NTH_PARTIAL, lambda parts: smallest(parts, size), compact_every)

    def sink(base: str) -> Callable[[DataFrame, int], None]:
        return lambda batch, i: log(batch.sparkSession, base).append(first_of_families(batch, families, size), i)

    base = run_query(spark, events, "stream-nth-milestones", "append", sink)
    return nth_of_partials(log(spark, base).read(), wanted)

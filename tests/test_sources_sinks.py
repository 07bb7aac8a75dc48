"""Loaders (partition pruning, logs) and sinks (export, materialise)."""

import os
import uuid

import pytest

from milepost.functions import families as fam
from milepost.operators import milestones as ms
from milepost.plans import export
from milepost.session import scratch_path
from milepost.sources import documents as docs
from milepost.sources import events as evsrc
from tests.conftest import AS_OF, DEFAULT_PARAMS, ev, events_df


def test_load_events_prunes_partitions(spark):
    rows = [ev("a", "first_open", f"2024-01-{d:02d}T10:00:00", DEFAULT_PARAMS) for d in range(1, 6)]
    path = scratch_path(spark, "events-test")
    evsrc.write_events(events_df(spark, rows), path, mode="overwrite")
    df = evsrc.load_events(spark, path, date_from="2024-01-03", columns=["event_name"])
    assert df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan or "event_date" in plan
    assert df.schema.fieldNames() == ["event_name", "event_date"]
    assert evsrc.load_events(spark, path).count() == 5


def test_scan_logs(spark):
    d = scratch_path(spark, "logs-test")
    lines = [
        "2024-01-01 00:00:07 - root - INFO - started",
        "2024-01-01 00:01:00 - root - CRITICAL - Amount - spent - 3",
        "garbage line",
    ]
    with open(os.path.join(d.replace("file:", ""), "tool.log"), "w") as f:
        f.write("\n".join(lines) + "\n")
    out = docs.scan_logs(spark, d).collect()
    assert [(r["level"], r["message"]) for r in out] == [("INFO", "started"), ("CRITICAL", "Amount - spent - 3")]


def test_write_report_and_materialize(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a")], "n int, s string")
    base = scratch_path(spark, "export-test")
    path = export.write_report(df, base, "Journey", AS_OF, fmt="csv", order_by=["s"])
    assert path.endswith("Journey_2024-01-30_12-00")
    back = spark.read.option("header", "true").csv(path).collect()
    assert [r["s"] for r in back] == ["a", "b"]
    with pytest.raises(Exception):
        export.write_report(df, base, "Journey", AS_OF, fmt="csv")  # never overwrite
    view = f"v_{uuid.uuid4().hex[:8]}"
    assert export.materialize(df, view).count() == 2
    assert spark.table(view).count() == 2


def test_explode_params_is_inner(spark):
    from milepost.operators.params import explode_params

    rows = [
        ev("a", "screen_view", "2024-01-01T00:00:00", [("firebase_screen", "Home"), ("firebase_screen", None)]),
        ev("a", "user_facing_error", "2024-01-01T00:00:01", []),
        ev("b", "first_open", "2024-01-01T00:00:02", None),
    ]
    out = explode_params(events_df(spark, rows)).collect()
    assert [(r["user_pseudo_id"], r["param_key"], r["param_value"]) for r in out] == [
        ("a", "firebase_screen", "Home"),
        ("a", "firebase_screen", None),
    ]


def test_hot_day_is_split_over_writers(spark):
    rows = [ev(f"u{i:03d}", "first_open", "2024-01-05T10:00:00", DEFAULT_PARAMS) for i in range(400)]
    path = scratch_path(spark, "hot-day")
    evsrc.write_events(events_df(spark, rows), path, mode="overwrite", partitions=4)
    day = os.path.join(path.replace("file:", ""), "event_date=2024-01-05")
    files = [f for f in os.listdir(day) if f.endswith(".parquet")]
    assert len(files) >= 2  # one day, several writer tasks
    assert evsrc.load_events(spark, path).count() == 400


def scanned_rows(df):
    """Rows that the plan's file scans gave to Spark, after Parquet's own skipping."""
    df.collect()
    found = []

    def walk(node):
        if "Scan parquet" in node.nodeName():
            found.append(node.metrics().get("numOutputRows").get().value())
        if node.nodeName().endswith("QueryStage"):
            walk(node.plan())
        children = node.children().iterator()
        while children.hasNext():
            walk(children.next())

    plan = df._jdf.queryExecution().executedPlan()
    walk(plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return found


def test_family_scans_skip_other_classes(spark):
    names = ["receive_email_x", "open_email_x", "create_email_x", "screen_view", "session_start", "first_open", None]
    rows = [ev(f"u{i % 50:02d}", names[i % len(names)], f"2024-01-0{1 + i % 2}T10:00:00", DEFAULT_PARAMS) for i in range(2800)]
    events = events_df(spark, rows)
    by_class, by_user = scratch_path(spark, "by-class"), scratch_path(spark, "by-user")
    evsrc.write_events(events, by_class, mode="overwrite", partitions=2, page_rows=50)
    (
        events.repartitionByRange(2, "event_date", "user_pseudo_id")
        .sortWithinPartitions("event_date", "user_pseudo_id")
        .write.mode("overwrite")
        .option("parquet.page.row.count.limit", 50)
        .partitionBy("event_date")
        .parquet(by_user)
    )
    scans = {p: ms.nth_events(evsrc.load_events(spark, p), [(fam.MESSAGES, 2, "second")]) for p in (by_class, by_user)}
    read = {p: sum(scanned_rows(df)) for p, df in scans.items()}
    assert read[by_user] == len(rows)
    assert read[by_class] < 0.5 * len(rows)  # two classes of seven
    assert sorted(map(tuple, scans[by_class].collect())) == sorted(map(tuple, scans[by_user].collect()))
    assert evsrc.load_events(spark, by_class).count() == len(rows)


def test_lookups_use_bloom_filters(spark):
    """Users whose ids lie within a file's minimum and maximum but aren't there."""
    rows = [ev(f"user-{2 * i:05d}", "screen_view", "2024-01-01T10:00:00", DEFAULT_PARAMS) for i in range(500)]
    path = scratch_path(spark, "bloom")
    evsrc.write_events(events_df(spark, rows), path, mode="overwrite", partitions=1)
    there = evsrc.load_events(spark, path).filter("user_pseudo_id = 'user-00400'")
    not_there = evsrc.load_events(spark, path).filter("user_pseudo_id = 'user-00401'")
    assert scanned_rows(there) == [500] and scanned_rows(not_there) == [0]


def test_a_hot_users_day_is_split_over_writers(spark):
    rows = [ev("hot", "screen_view", f"2024-01-01T{i % 24:02d}:00:00", DEFAULT_PARAMS) for i in range(600)]
    rows += [ev(None, "screen_view", f"2024-01-01T{i % 24:02d}:30:00", DEFAULT_PARAMS) for i in range(600)]
    path = scratch_path(spark, "hot-day")
    evsrc.write_events(events_df(spark, rows), path, mode="overwrite", partitions=8)
    files = evsrc.load_events(spark, path).groupBy("_metadata.file_name").count().collect()
    assert len(files) >= 7 and max(r["count"] for r in files) < 0.3 * len(rows)

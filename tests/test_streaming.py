"""Streams against their batch twins, with out-of-order and too-late rows."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from milepost.operators import availability as av
from milepost.operators import spend as sp
from milepost.session import scratch_path
from milepost.sources import streams as st
from milepost.streaming import jobs
from milepost.streaming.windows import WindowTables

PROBE_SCHEMA = "ts timestamp, provider string, task string, status_code int, exception_type string, body string"
OK_BODY = '{"res_jobs":[{"error":null}]}'


def _write_files(spark, folder, batches, schema):
    for rows in batches:  # sequential writes -> files arrive in this order
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_go_to_a_side_table(spark):
    """Rows behind the watermark change no total and are kept beside: totals and
    late rows together are the batch twin."""
    t0 = datetime(2024, 1, 1, 10, 0)
    first = [(t0 + timedelta(minutes=m), "p0", "summarization", 200, None, OK_BODY) for m in range(0, 300, 20)]
    second = [
        (t0 + timedelta(hours=3, minutes=30), "p0", "summarization", 500, None, None),  # in order
        (t0 + timedelta(hours=2, minutes=50), "p0", "summarization", 500, None, None),  # late but within 2h
        (t0 - timedelta(hours=2), "p0", "summarization", 500, None, None),  # its window is closed
    ]
    third = [(t0 + timedelta(minutes=1), "p0", "summarization", 200, None, OK_BODY)] * 2
    folder = scratch_path(spark, "probe-stream")
    _write_files(spark, folder, [first, second, third], PROBE_SCHEMA)
    tables = jobs.availability_tables(spark, st.parquet_stream(spark, folder, max_files_per_trigger=1))

    def counts(rows):
        twin = jobs.availability_windows(av.classify(spark.createDataFrame(rows, PROBE_SCHEMA)))
        return {(r["window_start"], r["probes"], r["failures"]) for r in twin.collect()}

    got = {(r["window_start"], r["probes"], r["failures"]) for r in tables.windows().collect()}
    assert got == counts(first + second[:2])
    late = sorted((r["ts"], r["ok"]) for r in tables.late_rows().collect())
    assert late == sorted([(second[2][0], False), (third[0][0], True), (third[0][0], True)])
    added = {(r["window_start"], r["probes"], r["failures"]) for r in tables.late_windows().collect()}
    assert added == counts(second[2:]) | counts(third)
    control = tables.control()
    assert (control["rows"], control["late"], control["batch"]) == (len(first) + 5, 3, 2)
    # A closed window is written once, an open one is in the last batch only.
    closed = {r["window_start"] for r in tables.closed_windows().collect()}
    still_open = {r["window_start"] for r in tables.open_windows(2).collect()}
    assert closed and still_open and not closed & still_open
    assert closed | still_open == {w for w, _, _ in got}


def test_files_read_do_not_grow_with_the_number_of_batches(spark):
    """Twelve batches into one window leave as many live files as three."""
    t0 = datetime(2024, 1, 1, 10, 0)
    spec = jobs.availability_spec()
    schema = av.classify(spark.createDataFrame([], PROBE_SCHEMA)).schema
    live = []
    for batches in (3, 12):
        tables = WindowTables(spark, scratch_path(spark, "many-batches"), spec, schema)
        for i in range(batches):
            rows = [(t0 + timedelta(minutes=i), "p0", f"t{j}", 200, None, OK_BODY) for j in range(3)]
            tables.write(av.classify(spark.createDataFrame(rows, PROBE_SCHEMA).coalesce(1)), i)
        got = tables.windows()
        assert {(r["task"], r["probes"]) for r in got.collect()} == {(f"t{j}", batches) for j in range(3)}
        live.append(len(got.inputFiles()))
        assert len(tables.files.names("state")) == 2 and len(tables.files.names("control")) == 2
    assert live[1] <= live[0]


def test_a_retried_batch_changes_nothing(spark):
    t0 = datetime(2024, 1, 1, 10, 0)
    schema = av.classify(spark.createDataFrame([], PROBE_SCHEMA)).schema
    tables = WindowTables(spark, scratch_path(spark, "retried"), jobs.availability_spec(), schema)

    def batch(hours, n):
        rows = [(t0 + timedelta(hours=hours), "p0", "t", 200, None, OK_BODY)] * n
        return av.classify(spark.createDataFrame(rows, PROBE_SCHEMA))

    tables.write(batch(0, 2), 0)
    tables.write(batch(9, 1), 1)
    tables.write(batch(0, 3), 2)  # late
    before = sorted(map(tuple, tables.windows().collect())), tables.late_rows().count(), tables.control()
    tables.write(batch(0, 3), 2)
    assert (sorted(map(tuple, tables.windows().collect())), tables.late_rows().count(), tables.control()) == before
    assert before[1] == 3 and before[2]["late"] == 3


def test_a_snapshot_delivered_twice_counts_once(spark):
    schema = "snapshot_id int, snapshot_time timestamp, id string, workersMin int"
    t = datetime(2024, 1, 1, 0, 5)
    snapshot = [(1, t, f"e{i}", 2) for i in range(5)]
    other = [(2, t + timedelta(minutes=5), "e0", None), (2, t + timedelta(minutes=5), "e1", 4)]
    folder = scratch_path(spark, "snapshots")
    _write_files(spark, folder, [snapshot[:3], snapshot[2:], other, snapshot + other], schema)
    tables = jobs.worker_tables(spark, st.parquet_stream(spark, folder, max_files_per_trigger=1))
    got = {(r["snapshot_id"], r["endpoints"], r["workers"]) for r in tables.windows().collect()}
    assert got == {(1, 5, 10), (2, 2, 4)}
    alerts = jobs.run_workers(spark, st.parquet_stream(spark, folder, max_files_per_trigger=1), 9)
    assert [(r["snapshot_id"], r["workers"]) for r in alerts.collect()] == [(1, 10)]


def test_redelivered_probes_and_spend_count_once(spark):
    t = datetime(2024, 1, 1, 1, 0)
    probes = [(t, "p0", "t", 200, None, OK_BODY, 1), (t, "p0", "t", 500, None, None, 2)]
    folder = scratch_path(spark, "probes-again")
    _write_files(spark, folder, [probes, probes[1:]], PROBE_SCHEMA + ", probe_id long")
    out = jobs.run_availability(spark, st.parquet_stream(spark, folder, 1), ids=("probe_id",))
    assert [(r["probes"], r["failures"]) for r in out.collect()] == [(2, 1)]
    spend = [("p0", t, Decimal("5.00"), 1), ("p0", t, Decimal("5.00"), 2)]
    folder = scratch_path(spark, "spend-again")
    _write_files(spark, folder, [spend, spend], "provider string, ts timestamp, amount decimal(18,2), event_id long")
    out = jobs.run_daily_spend(spark, st.parquet_stream(spark, folder, 1), 9, 20, ids=("event_id",))
    assert [(r["total"], r["severity"]) for r in out.collect()] == [(Decimal("10.00"), "soft")]


LATCH_SCHEMA = "provider string, day date, severity string, switch_ok boolean"


def latch_rows():
    days = [datetime(2024, 1, d).date() for d in range(1, 9)]
    sev = ["hard", "none", "hard", "hard", "soft", "hard", "hard", "none"]
    ok = [False, False, False, True, False, True, False, False]
    rows = [("p0", d, s, o) for d, s, o in zip(days, sev, ok)] + [("p1", d, "hard", False) for d in days]
    rows += [(None, d, s, o) for d, s, o in zip(days, sev[::-1], ok[::-1])]
    return rows + [("p2", days[4], "hard", True), ("p2", days[2], "hard", True), ("p2", days[6], "hard", None)]


def _latch_key(rows):
    return sorted(map(str, map(tuple, rows)))


def test_latch_stream_equals_batch_across_batches(spark):
    rows = latch_rows()
    folder = scratch_path(spark, "latch-stream")
    _write_files(spark, folder, [rows[2::3], rows[0::3], rows[1::3]], LATCH_SCHEMA)
    streamed = jobs.run_latch(spark, st.parquet_stream(spark, folder, max_files_per_trigger=1))
    batch = sp.latch(spark.createDataFrame(rows, LATCH_SCHEMA)).select("provider", "day", "severity", "activate")
    assert _latch_key(streamed.collect()) == _latch_key(batch.collect())
    p0 = [r["activate"] for r in streamed.filter("provider = 'p0'").orderBy("day").collect()]
    assert p0 == [True, False, True, True, False, False, False, False]


def test_latch_takes_decisions_back_for_any_split(spark):
    """Day 5 is decided before a success of day 3 is known, and so on: any deal
    of the days over batches gives the batch latch, also with compaction."""
    rows = latch_rows()
    want = _latch_key(sp.latch(spark.createDataFrame(rows, LATCH_SCHEMA)).select(*jobs.LATCH_OUT.names).collect())
    rng = random.Random(11)
    for every in (1, 2, 8):
        mixed = rng.sample(rows, len(rows))
        cuts = sorted(rng.sample(range(1, len(rows)), 4))
        parts = [mixed[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        tables = jobs.LatchTables(spark, scratch_path(spark, "latch-split"), every)
        for i, part in enumerate(parts):
            tables.write(spark.createDataFrame(part, LATCH_SCHEMA), i)
            if i == 2:  # a retried batch
                tables.write(spark.createDataFrame(part, LATCH_SCHEMA), i)
            so_far = spark.createDataFrame([r for p in parts[: i + 1] for r in p], LATCH_SCHEMA)
            assert _latch_key(tables.decisions().collect()) == _latch_key(sp.latch(so_far).select(*jobs.LATCH_OUT.names).collect())
        assert _latch_key(tables.decisions().collect()) == want
        assert len(tables.log.parts()) <= 2 * every


def test_nth_milestones_stream_for_any_split(spark):
    from tests.conftest import DEFAULT_PARAMS, ev, events_df

    from milepost.functions.specs import JOURNEY_NTH
    from milepost.operators import milestones as ms

    rng = random.Random(5)
    names = ["open_email_x", "create_email_x", "integration_created_slack", "integration_created_msteams", "session_start"]
    rows = [
        ev(rng.choice(["a", "b", None]), rng.choice(names), f"2024-01-{rng.randint(1, 9):02d}T{rng.randint(0, 3):02d}:00:00", DEFAULT_PARAMS)
        for _ in range(150)
    ]
    columns = [c for _, _, c in JOURNEY_NTH]
    want = ms.format_cet(ms.nth_events(events_df(spark, rows), JOURNEY_NTH), columns)
    mixed = rng.sample(rows, len(rows))
    folder = scratch_path(spark, "nth-stream")
    for i in range(5):
        events_df(spark, mixed[i::5] + mixed[:3]).coalesce(1).write.mode("append").parquet(folder)
    for every in (1, 3, 8):
        got = jobs.run_nth_milestones(spark, st.parquet_stream(spark, folder, 1), JOURNEY_NTH, compact_every=every)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_daily_spend_stream(spark):
    schema = "provider string, ts timestamp, amount decimal(18,2)"
    t = datetime(2024, 1, 1, 1, 0)
    files = [
        [("p0", t, Decimal("150.00")), ("p0", t + timedelta(days=1), Decimal("10.00"))],
        [("p0", t + timedelta(hours=5), Decimal("100.00")), ("p1", t + timedelta(days=1), Decimal("5.00"))],
    ]
    folder = scratch_path(spark, "spend-stream")
    _write_files(spark, folder, files, schema)
    out = jobs.run_daily_spend(spark, st.parquet_stream(spark, folder, max_files_per_trigger=1), 100, 200)
    got = {(r["provider"], str(r["day"])): (r["total"], r["severity"]) for r in out.collect()}
    assert got == {
        ("p0", "2024-01-01"): (Decimal("250.00"), "hard"),  # updated across two batches
        ("p0", "2024-01-02"): (Decimal("10.00"), "none"),
        ("p1", "2024-01-02"): (Decimal("5.00"), "none"),
    }


def test_milestone_partials_merge(spark):
    from tests.conftest import DEFAULT_PARAMS, ev, events_df
    from milepost.plans.stream_registry import STREAM_SPECS

    rows = [
        ev("a", "first_open", "2024-01-02T10:00:00", DEFAULT_PARAMS),
        ev("a", "first_open", "2024-01-05T10:00:00", DEFAULT_PARAMS),
        ev("b", "integration_created_zoom", "2024-01-03T10:00:00", DEFAULT_PARAMS),
    ]
    folder = scratch_path(spark, "ms-stream")
    df = events_df(spark, rows)
    for i in range(2):
        df.filter(F.col("event_id") % 2 == i).coalesce(1).write.mode("append").parquet(folder)
    for k in (8, 1, 2):  # not yet / every batch / every second batch compacted
        res = jobs.run_milestones(spark, st.parquet_stream(spark, folder, 1), STREAM_SPECS, compact_every=k)
        out = {r["user_pseudo_id"]: r for r in res.collect()}
        assert out["a"]["first_open_first"] == "2024-01-02 11:00:00"
        assert out["a"]["first_open_latest"] == "2024-01-05 11:00:00"
        assert out["b"]["any_integration_first"] == "2024-01-03 11:00:00"
        assert len(out) == 2


def test_streams_with_no_rows_give_empty_tables(spark):
    folder = scratch_path(spark, "empty-probes")
    spark.createDataFrame([], PROBE_SCHEMA).write.mode("overwrite").parquet(folder)
    out = jobs.run_availability(spark, st.parquet_stream(spark, folder))
    assert out.count() == 0 and "failures" in out.columns
    lfolder = scratch_path(spark, "empty-latch")
    spark.createDataFrame([], "provider string, day date, severity string, switch_ok boolean").write.mode("overwrite").parquet(lfolder)
    assert jobs.run_latch(spark, st.parquet_stream(spark, lfolder)).count() == 0

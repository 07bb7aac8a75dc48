"""Journey report: quirk fixtures and plan equivalence (fused, joined, SQL)."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from milepost.functions import daybits as db
from milepost.functions.timefmt import cet_text
from milepost.operators import activity as act
from milepost.plans import incremental as inc
from milepost.plans import journey as jr
from milepost.plans.versions import VersionedTables
from milepost.session import scratch_path
from tests.conftest import AS_OF, DEFAULT_PARAMS, ev, events_df, rows_of

D = DEFAULT_PARAMS
SCREEN = lambda v: [("firebase_screen", v), ("firebase_screen_class", "MainActivity")]


def fixture_rows():
    return [
        # user a: full journey, ties, wildcards, bounds, future event
        ev("a", "first_open", "2024-01-10T08:00:00", D, "ua", "x"),
        ev("a", "onboarding_step1_registration_complete", "2024-01-10T09:00:00", D, "ua", "x"),
        ev("a", "onboarding_step3_phone_verified_complete", "2024-01-10T10:00:00", D, "ua", "x"),
        ev("a", "onboarding_step3_phone_verified_complete", "2024-01-11T10:00:00", D, "ua2", "x"),
        ev("a", "integration_created_gmailemail", "2024-01-11T10:00:00", D, "ua", "x"),
        ev("a", "integration_created_slack", "2024-01-12T10:00:00", D, "ua", "x", event_id=901),
        ev("a", "integration_created_msteams", "2024-01-12T10:00:00", D, "ua", "x", event_id=900),
        ev("a", "receiveX3p_message_a", "2024-01-13T10:00:00", D, "ua", "x"),
        ev("a", "Receive_email_x", "2024-01-12T10:00:00", D, "ua", "x"),
        ev("a", "screen_view", "2024-01-30T00:00:00", [("firebase_screen", "Home"), ("firebase_screen", "Home")], "ua", "x"),
        ev("a", "screen_view", "2024-01-29T20:00:00", SCREEN(None), "ua", "x"),
        ev("a", "user_facing_error", "2024-01-20T10:00:00", [], "ua", "x"),
        ev("a", "user_facing_error", "2024-01-21T10:00:00", None, "ua", "x"),
        ev("a", "open_email_gmail", "2024-02-05T10:00:00", D, "ua", "x"),
        ev("a", "session_start", "2023-12-31T00:00:00", D, "ua", "x"),
        ev("a", "session_start", "2023-12-30T23:59:59", D, "ua", "x"),
        ev("a", None, "2024-01-25T10:00:00", D, "ua", "x"),
        # user b: only location_complete -> not in the cohort
        ev("b", "onboarding_step7_location_complete", "2024-01-05T10:00:00", D),
        # user c: carplay + location_complete -> step3 NULL unless all_events
        ev("c", "onboarding_step7_carplay_complete", "2024-01-06T10:00:00", D, None, "y"),
        ev("c", "onboarding_step7_location_complete", "2024-01-07T10:00:00", D, None, "y"),
        # user d: screen view exactly 24h before as_of
        ev("d", "onboarding_step7_carplay_complete", "2024-01-06T10:00:00", D),
        ev("d", "screen_view", "2024-01-29T12:00:00", SCREEN("Welcome"), None, None),
        # user e: only an old screen view (80h)
        ev("e", "first_open", "2024-01-02T10:00:00", D, None, "z"),
        ev("e", "screen_view", "2024-01-27T04:00:00", SCREEN("Welcome"), None, "z"),
        # user f: empty suffix still matches the LIKE
        ev("f", "integration_created_", "2024-01-08T10:00:00", D),
        # NULL user key with events of every kind
        ev(None, "first_open", "2024-01-09T10:00:00", D, "un", "n"),
        ev(None, "screen_view", "2024-01-30T01:00:00", SCREEN("Welcome"), "un", "n"),
        ev(None, "user_facing_error", "2024-01-30T01:00:00", [], "un", "n"),
        ev(None, "open_yesno_flags", "2024-01-30T02:00:00", D, "un", "n"),
        ev(None, "onboarding_step3_phone_verified_complete", "2024-01-09T11:00:00", D, "un", "n"),
    ]


def by_user(df):
    return {r["user_pseudo_id"]: r.asDict() for r in df.collect()}


def test_three_plans_agree(spark):
    ev_df = events_df(spark, fixture_rows())
    fused = rows_of(jr.user_journey(ev_df, AS_OF))
    joined = rows_of(jr.user_journey_joined(ev_df, AS_OF))
    sql = rows_of(jr.run_report(spark, jr.load_report_sql("user_journey"), ev_df, AS_OF))
    assert fused == joined == sql
    fused_all = rows_of(jr.user_journey(ev_df, AS_OF, scope="all_events"))
    joined_all = rows_of(jr.user_journey_joined(ev_df, AS_OF, scope="all_events"))
    assert fused_all == joined_all


def test_report_values(spark):
    out = by_user(jr.user_journey(events_df(spark, fixture_rows()), AS_OF))
    assert set(out) == {"a", "c", "d", "e", "f", None}  # Q2: b is not in the cohort
    a = out["a"]
    assert a["user_id"] == "ua"  # first verified event wins (W4)
    assert a["step1_first_open"] == "2024-01-10 09:00:00"  # CET = UTC+1 in winter
    assert a["step3_provides_permission"] is None  # Q1
    # F-6: tie at 2024-01-12T10:00 broken by event_id -> 3rd is id 901
    assert a["step5_connects_3_integrations"] == "2024-01-12 11:00:00"
    # F-7: '_' is a one-character wildcard; case matters
    assert a["step6_receives_and_opens_1st_message_or_email"] == "2024-01-13 11:00:00"
    # Q8: two matching params in one event count twice; NULL value never
    assert (a["screen_views_last_24h"], a["screen_views_last_48h"], a["screen_views_last_72h"]) == (2, 2, 2)
    assert a["user_error_count"] == 2
    # Q6 / F-11: day bound inclusive (2023-12-31), future day counted, NULL name ignored
    # 12-31, 01-10, 01-11, 01-12, 01-13, 01-20, 01-21, 01-29, 01-30, 02-05
    assert a["step17_days_active_in_last_30_days"] == 10
    assert a["step16_is_active_on_day_10"] is True
    assert out["d"]["screen_views_last_24h"] == 1  # exactly as_of - 24h is inside
    e = out["e"]
    assert e["last_screen_view"] == "2024-01-27 05:00:00"
    assert (e["screen_views_last_24h"], e["screen_views_last_72h"]) == (0, 0)  # Q7: 0 not NULL
    c = out["c"]
    assert c["last_screen_view"] is None and c["screen_views_last_24h"] is None  # Q7
    assert out["f"]["step4_connects_1_integration"] == "2024-01-08 11:00:00"
    assert out["f"]["step5_connects_3_integrations"] is None
    n = out[None]  # Q9: NULL key keeps its own milestones, side columns default
    assert n["step1_first_open"] == "2024-01-09 11:00:00"
    assert n["user_id"] is None and n["location"] is None and n["last_screen_view"] is None
    assert n["step6_receives_and_opens_1st_message_or_email"] is None
    assert n["step14_is_active_on_day_2"] is False
    assert n["user_error_count"] == 0 and n["step17_days_active_in_last_30_days"] == 0


def test_step3_all_events_scope(spark):
    out = by_user(jr.user_journey(events_df(spark, fixture_rows()), AS_OF, scope="all_events"))
    assert out["c"]["step3_provides_permission"] == "2024-01-07 11:00:00"
    assert "b" not in out


def test_cet_text_dst_and_day_split(spark):
    df = spark.createDataFrame(
        [("2024-03-31 00:59:00",), ("2024-03-31 01:00:00",), ("2024-10-27 00:30:00",), ("2024-10-27 01:30:00",), ("2024-01-15 23:30:00",)],
        "t string",
    ).select(F.to_timestamp("t").alias("ts"))
    got = [(r[0], r[1]) for r in df.select(cet_text(F.col("ts")), F.to_date("ts").cast("string")).collect()]
    assert got == [
        ("2024-03-31 01:59:00", "2024-03-31"),
        ("2024-03-31 03:00:00", "2024-03-31"),
        ("2024-10-27 02:30:00", "2024-10-27"),  # Q13: the autumn fold prints twice
        ("2024-10-27 02:30:00", "2024-10-27"),
        ("2024-01-16 00:30:00", "2024-01-15"),  # Q5: UTC day, CET text
    ]


def test_report_order(spark):
    ordered = jr.journey_report(events_df(spark, fixture_rows()), AS_OF).collect()
    firsts = [r["step1_first_open"] for r in ordered]
    non_null = [x for x in firsts if x is not None]
    assert non_null == sorted(non_null, reverse=True)
    assert firsts[len(non_null):] == [None] * (len(firsts) - len(non_null))  # NULLs last


def test_incremental_partials_equal_fused(spark):
    ev_df = events_df(spark, fixture_rows())
    base = scratch_path(spark, "partials-test")
    days = sorted({r[7] for r in fixture_rows()})
    # batches of days arrive out of order and one batch is re-run: the
    # result must not change
    batches = [days[1::3], days[0::3], days[2::3], days[0::3]]
    for batch in batches:
        inc.update_partials(ev_df.filter(F.col("event_date").isin(batch)), base)
    parts = inc.read_partials(spark, base)
    for scope in ("cohort", "all_events"):
        got = rows_of(inc.journey_from_partials(parts, ev_df, AS_OF, scope=scope))
        assert got == rows_of(jr.user_journey(ev_df, AS_OF, scope=scope))


def test_corrected_days_replace_their_partials(spark, tmp_path):
    def report(ev):
        inc_rows = inc.journey_from_partials(inc.read_partials(spark, base), ev, AS_OF, scope="all_events")
        return sorted(map(str, inc_rows.collect())), sorted(map(str, jr.user_journey(ev, AS_OF, scope="all_events").collect()))

    base = str(tmp_path / "partials")
    ev = events_df(spark, fixture_rows())
    inc.update_partials(ev, base)
    assert len(set(map(tuple, report(ev)))) == 1
    # Days that lose their verified, family and city rows, and a day that loses everything.
    gone = max(r[0] for r in ev.select("event_date").distinct().collect())
    kept = ev.filter((F.col("event_name") == "session_start") | F.col("event_name").startswith("first_"))
    kept = kept.withColumn("geo", F.lit(None).cast(ev.schema["geo"].dataType)).filter(F.col("event_date") != F.lit(gone))
    lost = [r[0] for r in ev.select("event_date").distinct().collect()]
    inc.update_partials(kept, base, days=lost)
    assert len(set(map(tuple, report(kept)))) == 1


def test_days_are_those_of_the_time_not_of_the_partition(spark):
    """Events of one UTC day in two partitions are one day, and an event whose
    partition is a day off counts by its time."""
    rows = [
        ev("a", "first_open", "2024-01-10T23:30:00", D),
        ev("a", "open_email_x", "2024-01-10T22:30:00", D),
        ev("a", "open_email_x", "2023-12-31T00:30:00", D),  # the first day that counts as recent
        ev("a", "open_email_x", "2023-12-30T23:30:00", D),  # stored in the next day's partition
        ev("a", None, "2024-01-20T10:00:00", D),
        ev(None, "first_open", "2024-01-10T23:30:00", D),
        ev("b", "first_open", "1969-12-31T23:30:00", D),
        ev("b", "first_open", "2199-12-31T23:30:00", D),
    ]
    shifted = F.when(F.pmod("event_id", F.lit(2)) == 0, F.date_add("event_date", 1)).otherwise(F.col("event_date"))
    for df in (events_df(spark, rows), events_df(spark, rows).withColumn("event_date", shifted)):
        days = {r[0]: r[1] for r in act.active_days(df).collect()}
        assert days == {"a": 3, None: 1, "b": 2}
        recent = {r[0]: r[1] for r in act.active_days(df, AS_OF, 30).collect()}
        assert recent == {"a": 2, None: 1, "b": 1}
        reports = [
            jr.user_journey(df, AS_OF),
            jr.user_journey_joined(df, AS_OF),
            jr.run_report(spark, jr.load_report_sql("user_journey"), df, AS_OF),
        ]
        base = scratch_path(spark, "shifted-days")
        inc.update_partials(df, base)
        reports.append(inc.journey_from_partials(inc.read_partials(spark, base), df, AS_OF))
        for out in map(by_user, reports):
            a = out["a"]
            assert (a["step14_is_active_on_day_2"], a["step15_is_active_on_day_5"]) == (True, False)
            assert a["step17_days_active_in_last_30_days"] == 2
            assert out["b"]["step17_days_active_in_last_30_days"] == 1
            assert out[None]["step14_is_active_on_day_2"] is False


def test_day_bitmaps_count_as_sets_do(spark):
    """Bitmaps of any days, merged in any parts, against Python sets."""
    rng = random.Random(3)
    first = date(2024, 1, 3)
    days = [first + timedelta(days=rng.randint(-400, 400)) for _ in range(300)] + [date(1960, 2, 29), date(2400, 1, 1)]
    rows = [(f"u{i % 7}", datetime(d.year, d.month, d.day, i % 24)) for i, d in enumerate(days + days[::3])]
    df = spark.createDataFrame(rows, "user string, ts timestamp").repartition(5)
    ts = F.col("ts")
    blocks = df.groupBy("user", db.block_of(ts).alias("b")).agg(F.bit_or(db.bit_of(ts)).alias("bits"))
    got = blocks.groupBy("user").agg(
        F.sum(db.count_days(F.col("bits"))).alias("all"),
        F.sum(db.count_days(db.days_since(F.col("b"), F.col("bits"), first))).alias("since"),
    )
    want = {}
    for u, t in rows:
        want.setdefault(u, set()).add(t.date())
    assert {r["user"]: (r["all"], r["since"]) for r in got.collect()} == {
        u: (len(s), sum(d >= first for d in s)) for u, s in want.items()
    }


def test_a_failed_update_leaves_the_old_report(spark, monkeypatch):
    base = scratch_path(spark, "atomic")
    old = events_df(spark, fixture_rows())
    inc.update_partials(old, base)

    def report(recent):
        return rows_of(inc.journey_from_partials(inc.read_partials(spark, base), recent, AS_OF))

    before = report(old)
    new = old.filter(F.col("event_name") != "first_open")
    days = [r[0] for r in old.select("event_date").distinct().collect()]
    whole = inc.day_tables

    def failing(ev):
        tables = whole(ev)
        cities = tables["cities"]
        broken = F.raise_error(F.lit("lost")).cast("string")
        return tables | {"cities": cities.withColumn("city", F.when(F.col("n") > 0, broken))}

    monkeypatch.setattr(inc, "day_tables", failing)
    with pytest.raises(Exception, match="lost"):
        inc.update_partials(new, base, days=days)
    monkeypatch.undo()
    assert report(old) == before  # two of four new tables were written
    inc.update_partials(new, base, days=days)
    after = report(new)
    assert after == rows_of(jr.user_journey(new, AS_OF)) and after != before
    tables = VersionedTables(spark, base)
    gone = tables.remove_old(inc.TABLES, keep=1)
    assert len(gone) >= 6  # the first version of four tables, two of the failed one
    assert report(new) == after


def test_updates_that_meet_keep_each_others_days(spark):
    """Two updates that read the same manifest: the second follows on the first."""
    base = scratch_path(spark, "meeting")
    tables, other = VersionedTables(spark, base), VersionedTables(spark, base)
    tables.commit("v1", ["2024-01-01", "2024-01-02"])
    load = tables._load

    def meanwhile(name):
        out = load(name)
        tables._load = load
        other.commit("v2", ["2024-01-02"])
        return out

    tables._load = meanwhile
    tables.commit("v3", ["2024-01-03"])
    assert tables.live() == {"2024-01-01": "v1", "2024-01-02": "v2", "2024-01-03": "v3"}

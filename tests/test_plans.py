"""Physical-plan assertions: the plans we rely on at scale."""

import re

import pytest

from milepost.functions import families as fam
from milepost.operators import milestones as ms
from milepost.operators.exclusion import exclude_users
from milepost.plans import journey as jr
from milepost.plans import new_users as nu
from milepost.plans.registry import materialized_events
from milepost.sources import events as evsrc
from tests.conftest import AS_OF, SF01


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ga_path(spark):
    return materialized_events(spark, SF01)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fused_journey_hash_aggregates_all_events(spark, ga_path):
    ev = evsrc.load_events(spark, ga_path)
    p = plan(jr.user_journey(ev, AS_OF))
    # the first level is a hash aggregate by (user, city, block of days); the
    # sort-based one, which the city's MIN needs, sees its result only
    assert re.search(r"HashAggregate\(keys=\[user_pseudo_id#\d+, location#\d+, _block#\d+\]", p)
    assert not re.search(r"SortAggregate\(key=\[[^\]]*location", p)
    assert "WindowGroupLimit" in p
    # no join needs its own shuffle of event rows: every join input is an
    # aggregate already partitioned by the user key
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("form", ["plan", "all_events", "sql"])
def test_fused_journey_has_two_scans_and_four_exchanges(spark, ga_path, no_broadcast, form):
    ev = evsrc.load_events(spark, ga_path)
    if form == "sql":
        df = jr.run_report(spark, jr.load_report_sql("user_journey"), ev, AS_OF)
    else:
        df = jr.user_journey(ev, AS_OF, scope="all_events" if form == "all_events" else "cohort")
    p = plan(df)
    assert p.count("FileScan parquet") == 2
    assert p.count("Exchange hashpartitioning") == 4
    # the tagged scan skips other events by their name's prefix
    assert "StringStartsWith(event_name," in p


def test_joined_plan_scans_more(spark, ga_path):
    ev = evsrc.load_events(spark, ga_path)
    assert plan(jr.user_journey_joined(ev, AS_OF)).count("FileScan parquet") == 12


def test_nth_prefilter_reaches_parquet(spark, ga_path):
    ev = evsrc.load_events(spark, ga_path)
    p = plan(ms.nth_event(ev, fam.MESSAGES, 10, "x"))
    assert "StringStartsWith(event_name,receive)" in p
    assert "WindowGroupLimit" in p


def test_new_users_scan_events_once(spark, ga_path, no_broadcast):
    ev = evsrc.load_events(spark, ga_path)
    excluded = spark.createDataFrame([("u37",)], "user_id string")
    p = plan(nu.new_users(ev, AS_OF, excluded))
    assert p.count("FileScan parquet") == 1 and "LeftAnti" in p
    # (user, id, city), user, and both sides of the exclusion with its DISTINCT.
    assert p.count("Exchange hashpartitioning") <= 4
    assert re.search(r"HashAggregate\(keys=\[user_pseudo_id#\d+, user_id#\d+, _groupingexpression#\d+\]", p)


def test_spend_alerts_come_from_one_pass(spark, no_broadcast):
    from milepost.plans import monitor_registry as mr

    p = plan(mr.q_spend_alerts(spark, SF01))
    # the daily totals, and each provider's first success joined to them
    assert p.count("Exchange hashpartitioning") - p.count("ReusedExchange") <= 5 and "Union" not in p


def test_no_job_runs_while_queries_are_built(spark, ga_path):
    ev = evsrc.load_events(spark, ga_path)
    listed = spark.createDataFrame([("u37",)], "user_id string")
    spark.sparkContext.setJobGroup("build-only", "queries are lazy")
    try:
        out = [nu.new_users(ev, AS_OF, listed), exclude_users(ev, listed, "user_id")]
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build-only")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "SinglePartition" not in "".join(map(plan, out))


def test_exclusion_is_anti_join(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "user_id string")
    lst = spark.createDataFrame([("a",)], "user_id string")
    out = exclude_users(df, lst, "user_id")
    assert sorted(r[0] or "" for r in out.collect()) == ["", "b"]
    assert "LeftAnti" in plan(out)


def test_cohort_prefilter_reaches_parquet(spark, ga_path):
    from milepost.functions.specs import JOURNEY_FIRST

    ev = evsrc.load_events(spark, ga_path)
    p = plan(ms.first_milestones(ev, JOURNEY_FIRST))
    # the plan text truncates long filter lists; the first prefix is enough
    assert "PushedFilters: [Or(Or(StringStartsWith(event_name,first)" in p

"""A user holding over a third of all events: results stay exact and the
plans reduce the hot key before any shuffle."""

from milepost.functions.specs import JOURNEY_NTH
from milepost.operators import milestones as ms
from milepost.plans import journey as jr
from tests.conftest import AS_OF, DEFAULT_PARAMS, events_df, rows_of, us

NAMES = ["receive_email_gmail", "create_yesno_flags", "integration_created_slack", "first_open", "screen_view"]


def skewed_rows():
    from datetime import datetime, timezone

    rows = []
    base = us("2024-01-01T00:00:00")
    eid = 0
    for user, n in [("hot", 1800), ("u1", 300), ("u2", 300), (None, 600)]:
        for i in range(n):
            eid += 1
            micros = base + (i * 7919 % 2_500_000) * 1_000_000
            day = datetime.fromtimestamp(micros / 1e6, tz=timezone.utc).date()
            name = NAMES[i % len(NAMES)]
            params = [("firebase_screen", "home")] if name == "screen_view" else DEFAULT_PARAMS
            rows.append((user, None if user is None else f"id-{user}", name, micros, ("c",), [(k, (v,)) for k, v in params], eid, day))
    return rows


def test_hot_user_exact(spark):
    ev = events_df(spark, skewed_rows()).repartition(8)
    fused = rows_of(jr.user_journey(ev, AS_OF))
    assert fused == rows_of(jr.user_journey_joined(ev, AS_OF))
    hot = [r for r in fused[0] if r[0] == "hot"][0]
    assert hot[20] == 0 and hot[16] is True


def test_hot_user_reduced_before_shuffle(spark):
    ev = events_df(spark, skewed_rows()).repartition(8)
    p = ms.nth_events(ev, JOURNEY_NTH)._jdf.queryExecution().executedPlan().toString()
    # rank limit applied in every map task, then again after the exchange
    assert "Partial" in p and "Final" in p and "WindowGroupLimit" in p
    j = jr.user_journey(ev, AS_OF)._jdf.queryExecution().executedPlan().toString()
    # every aggregate has a partial (map-side) step
    assert "partial_min" in j and "partial_sum" in j and "partial_count" in j

"""New-user report quirks (Q10-Q12, F6) and order."""

from milepost.plans import new_users as nu
from tests.conftest import AS_OF, DEFAULT_PARAMS, ev, events_df

D = DEFAULT_PARAMS


def rows():
    return [
        ev("n1", "first_open", "2024-01-29T13:00:00", D, "u1", "x"),
        ev("n1", "first_open", "2024-01-20T13:00:00", D, "u1", "x"),
        ev("n1", "screen_view", "2024-01-29T14:00:00", [("firebase_screen_class", "WELCOMESCREEN")], "u1", "x"),
        ev("n1", "integration_created_slack", "2024-01-29T15:00:00", D, "u1", "x"),
        # Q11: the latest first_open is the one reported
        ev("n2", "first_open", "2024-01-29T13:00:00", D, "u2"),
        ev("n2", "first_open", "2024-01-30T01:00:00", D, "u2"),
        # Q10: first_open without parameters is invisible
        ev("n3", "first_open", "2024-01-30T10:00:00", [], "u3"),
        ev("n4", "first_open", "2024-01-30T10:00:00", None, "u4"),
        # Q12: no first_open at all
        ev("n5", "screen_view", "2024-01-30T10:00:00", [("firebase_screen", "WelcomeScreen")], "u5"),
        # excluded user, and a NULL user id that must survive the exclusion
        ev("n6", "first_open", "2024-01-30T11:00:00", D, "bad"),
        ev("n7", "first_open", "2024-01-29T12:00:00", D, None),  # exactly as_of - 24h
        # future first_open passes (no upper bound)
        ev("n8", "first_open", "2024-02-02T12:00:00", D, "u8"),
        # a NULL user key is one group of its own and can be a new user
        ev(None, "first_open", "2024-01-30T09:00:00", D, None, "q"),
    ]


def test_new_users(spark):
    excluded = spark.createDataFrame([("bad",), (None,)], "user_id string")
    out = {r["User_Pseudo_ID"]: r.asDict() for r in nu.new_users(events_df(spark, rows()), AS_OF, excluded).collect()}
    assert set(out) == {"n1", "n2", "n7", "n8", None}
    assert out[None]["Location"] == "q"
    assert out["n2"]["First_Open"] == "2024-01-30 02:00:00"
    n1 = out["n1"]
    assert len(n1) == 30
    assert n1["First_Open"] == "2024-01-29 14:00:00"
    assert n1["Welcome_Screen"] == "2024-01-29 15:00:00"  # class param, case-insensitive
    assert n1["Integration_Slack"] == "2024-01-29 16:00:00"
    assert n1["User_ID"] == "u1" and n1["Location"] == "x"
    assert out["n7"]["User_ID"] is None


def test_new_users_order(spark):
    excluded = spark.createDataFrame([("bad",)], "user_id string")
    r = nu.new_users_report(events_df(spark, rows()), AS_OF, excluded).collect()
    assert [x["User_Pseudo_ID"] for x in r] == ["n8", None, "n2", "n1", "n7"]


def test_new_users_without_broadcast(spark):
    excluded = spark.createDataFrame([("bad",)], "user_id string")
    ev_df = events_df(spark, rows())
    small = {r["User_Pseudo_ID"] for r in nu.new_users(ev_df, AS_OF, excluded).collect()}
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for key in limits:
            spark.conf.set(key, "-1")
        large = {r["User_Pseudo_ID"] for r in nu.new_users(ev_df, AS_OF, excluded).collect()}
    finally:
        for key in limits:
            spark.conf.unset(key)
    assert small == large

"""Monitors against brute force on random inputs."""

import json
from datetime import date, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from milepost.operators import availability as av
from milepost.operators import spend as sp

day_st = st.tuples(st.sampled_from(["p0", "p1"]), st.integers(0, 20), st.sampled_from(["hard", "soft", "none"]), st.booleans())


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(day_st, min_size=1, max_size=30, unique_by=lambda r: (r[0], r[1])))
def test_latch_matches_brute_force(spark, rows):
    data = [(p, date(2024, 1, 1) + timedelta(days=d), sev, ok) for p, d, sev, ok in rows]
    df = spark.createDataFrame(data, "provider string, day date, severity string, switch_ok boolean")
    got = {(r["provider"], r["day"]): r["activate"] for r in sp.latch(df).collect()}
    want = {}
    for p in {r[0] for r in data}:
        latched = False
        for _, d, sev, ok in sorted(r for r in data if r[0] == p):
            act = sev == "hard" and not latched
            want[(p, d)] = act
            if act and ok:
                latched = True
    assert got == want
    assert got == {(r["provider"], r["day"]): r["activate"] for r in sp.latch_window(df).collect()}


body_st = st.one_of(
    st.none(),
    st.just("not json"),
    st.just("{}"),
    st.builds(
        lambda jobs: json.dumps({"res_jobs": jobs}),
        st.lists(st.fixed_dictionaries({"error": st.one_of(st.none(), st.sampled_from(["", "x", "IN_QUEUE"]))}), max_size=2),
    ),
)
probe_st = st.tuples(
    st.sampled_from(["p0", "p1", "p9"]),
    st.one_of(st.none(), st.sampled_from([200, 500, 404])),
    st.sampled_from([None, "timeout", "connection"]),
    body_st,
)


def brute(provider, status, exc, body):
    rule = {"p0": "status_and_error", "p1": "status_only"}.get(provider, "status_and_error")
    if status is None:
        return exc or "other"
    if status != 200:
        return "http_error"
    try:
        jobs = json.loads(body)["res_jobs"] if body is not None else None
    except (ValueError, KeyError, TypeError):
        jobs = None
    if not isinstance(jobs, list) or not jobs:
        return "malformed_response"
    err = jobs[0].get("error")
    if rule == "status_and_error" and err not in (None, ""):
        return "error_message"
    return None


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(probe_st, min_size=1, max_size=30))
def test_classify_matches_brute_force(spark, probes):
    rows = [(i, "2024-01-01 00:00:00", p, "summarization", s, e, b) for i, (p, s, e, b) in enumerate(probes)]
    df = spark.createDataFrame(rows, "i int, ts string, provider string, task string, status_code int, exception_type string, body string")
    out = av.classify(df.drop("i"), {"p1": av.STATUS_ONLY})
    got = [(r["ok"], r["failure_class"]) for r in out.collect()]
    want = [(brute(p, s, e, b) is None, brute(p, s, e, b)) for p, s, e, b in probes]
    assert sorted(got, key=str) == sorted(want, key=str)

"""Spend, fleet, availability and quality monitors on hand-made inputs."""

import json
from datetime import date
from decimal import Decimal

import pytest

from milepost.operators import availability as av
from milepost.operators import fleet as fl
from milepost.operators import quality as qa
from milepost.operators import spend as sp
from milepost.sources import documents as docs


RULES = {"p1": av.STATUS_ONLY}


def bill_doc(records):
    return json.dumps({"data": {"myself": {"billing": {"summary": records}}}})


def test_latest_bill_and_total(spark):
    recs = [
        {"time": "2024-01-03T00:00:00Z", "gpuCloudAmount": 2.675, "cpuCloudAmount": 0.125, "endpointAmount": 0,
         "serverlessAmount": 1, "storageAmount": 0},
        {"time": "2024-01-02T00:00:00Z", "gpuCloudAmount": 9, "cpuCloudAmount": 0, "endpointAmount": 0,
         "serverlessAmount": 0, "storageAmount": 0},
    ]
    bills = docs.load_billing(spark.createDataFrame([("p", bill_doc(recs))], "provider string, body string"))
    latest = sp.latest_bill(bills).collect()
    assert len(latest) == 1 and latest[0]["gpuCloudAmount"] == Decimal("2.675")  # Q14: newest, not today's
    total = sp.bill_total(sp.latest_bill(bills)).collect()[0]["total"]
    assert total == Decimal("3.80")  # 2.675 + 0.125 + 1, rounded once (Q16)


def test_amounts_are_rounded_once_and_any_amount_counts(spark):
    def total(**record):
        body = bill_doc([{"time": "2024-01-03T00:00:00Z", **record}])
        bills = docs.load_billing(spark.createDataFrame([("p", body)], "provider string, body string"))
        return sp.bill_total(bills).collect()[0]["total"]

    assert total(**{f: 0.004 for f in docs.BILL_FIELDS}) == Decimal("0.02")
    assert total(fooAmount=100.0, barAmount=None, bazAmount="n/a", gpuCloudAmount=1) == Decimal("101.00")
    assert total(amountOfNothing=5) == Decimal("0.00")
    body = json.dumps({"costs": {"2024-01-01": {"total_cost_cents": 0.4996}}})
    costs = docs.load_app_costs(spark.createDataFrame([("a", "p", body)], "app string, project string, body string"))
    assert sp.spend_on(costs).collect()[0]["total"] == Decimal("0.00")


def test_latch_and_alerts_of_no_provider(spark):
    rows = [(None, date(2024, 1, d), Decimal("250.00"), True) for d in (1, 2, 3)]
    df = sp.severity(spark.createDataFrame(rows, "provider string, day date, total decimal(18,2), switch_ok boolean"), 100, 200)
    assert sorted(r["activate"] for r in sp.latch(df).collect()) == [False, False, True]
    alerts = sp.spend_alerts(sp.latch(df), 100, 200, dedup=True).collect()
    assert len(alerts) == 4 and {r["source"] for r in alerts} == {"spend:unknown"}


def test_failure_classes_are_a_closed_set(spark):
    rows = [("ReadTimeout: host x:443 after 120s",), ("ConnectionError",), ("KeyError: 'a'",), (None,)]
    probes = spark.createDataFrame(
        [(None, "p0", "t", None, None, e) for (e,) in rows],
        "ts timestamp, provider string, task string, status_code int, body string, exception_type string",
    )
    got = sorted(r["failure_class"] for r in av.classify(probes).collect())
    assert got == ["connection", "other", "other", "timeout"]


def test_latest_bill_tie_keeps_first(spark):
    df = spark.createDataFrame(
        [("p", "2024-01-01", 1, Decimal("1.00")), ("p", "2024-01-01", 0, Decimal("2.00"))],
        "provider string, time string, pos int, fooAmount decimal(18,2)",
    )
    r = sp.latest_bill(df, tiebreak="pos").collect()[0]
    assert r["pos"] == 0 and r["fooAmount"] == Decimal("2.00")
    # Q15: a new *Amount column joins the sum; a non-numeric one is refused
    assert sp.bill_total(df, keep=("provider",)).collect()[0]["total"] in (Decimal("1.00"), Decimal("2.00"))
    with pytest.raises(TypeError):
        sp.bill_total(df.withColumn("badAmount", df["time"]), keep=("provider",))


def test_severity_latch_and_alerts(spark):
    # F-9: over, under, over, over, over; switch results F, -, T, T(not called), -
    rows = [
        ("p", date(2024, 1, 1), Decimal("250.00"), False),
        ("p", date(2024, 1, 2), Decimal("50.00"), False),
        ("p", date(2024, 1, 3), Decimal("250.00"), True),
        ("p", date(2024, 1, 4), Decimal("300.00"), True),
        ("p", date(2024, 1, 5), Decimal("150.00"), False),
    ]
    df = spark.createDataFrame(rows, "provider string, day date, total decimal(18,2), switch_ok boolean")
    sev = sp.severity(df, soft=100, hard=200)
    assert [r["severity"] for r in sev.orderBy("day").collect()] == ["hard", "none", "hard", "hard", "soft"]
    latched = sp.latch(sev)
    assert [r["activate"] for r in latched.orderBy("day").collect()] == [True, False, True, False, False]
    assert sorted(map(tuple, latched.collect())) == sorted(map(tuple, sp.latch_window(sev).collect()))
    alerts = sp.spend_alerts(latched, 100, 200).collect()
    assert len(alerts) == 4 + 2  # every over-limit day alerts again (Q19) + two switch calls
    msgs = [a["message"] for a in alerts]
    assert any("Amount spent: 300.00. Hard Threshod limit is: 200.0" in m for m in msgs)
    assert any("Soft threshold is set to: `$100.0`" in m for m in msgs)


def test_app_costs_and_missing_days(spark):
    body = json.dumps({"costs": {"2024-01-01": {"total_cost_cents": 1234.5}, "2024-01-03": {"total_cost_cents": 100}}})
    costs = docs.load_app_costs(spark.createDataFrame([("a1", "p1", body)], "app string, project string, body string"))
    totals = {r["day"]: r["total"] for r in sp.spend_on(costs).collect()}
    assert totals == {"2024-01-01": Decimal("12.35"), "2024-01-03": Decimal("1.00")}
    asked = {r["day"]: r["total"] for r in sp.spend_on(costs, ["2024-01-02", "2024-01-03"]).collect()}
    assert asked == {"2024-01-02": Decimal("0.00"), "2024-01-03": Decimal("1.00")}
    missing = sp.missing_cost_days(costs.select("app").distinct(), costs, "2024-01-01", "2024-01-03").collect()
    assert [(r["app"], r["day"]) for r in missing] == [("a1", "2024-01-02")]


def test_worker_totals_and_desired_state(spark):
    eps = [
        {"name": "e1", "workersMin": 2, "id": "1", "gpuCount": 1, "templateId": "t"},
        {"name": "e2", "id": "2"},
        {"name": "e3", "workersMin": None, "id": "3"},
    ]
    doc = json.dumps({"data": {"myself": {"endpoints": eps}}})
    endpoints = docs.load_endpoints(spark.createDataFrame([(1, doc)], "snapshot_id int, body string"))
    tot = fl.worker_totals(endpoints, by="snapshot_id").collect()[0]
    assert (tot["endpoints"], tot["workers"]) == (3, 2)  # Q20: missing and null count 0
    assert fl.worker_alerts(fl.worker_totals(endpoints, by="snapshot_id"), 2, by="snapshot_id").count() == 0  # F10
    names = docs.parse_target_list(spark.createDataFrame([('["e1", "e3"]',)], "targets string"))
    desired = fl.desired_workers(endpoints, names, "deactivate")
    assert desired.columns == fl.MUTATION_FIELDS
    assert sorted(r["workersMin"] for r in desired.collect()) == [0, 0]
    payload = json.loads(fl.desired_payload(desired).filter("id = '1'").collect()[0]["payload"])
    assert payload["variables"]["input"]["workersMin"] == 0 and "templateId" not in payload["variables"]["input"]
    with pytest.raises(ValueError):
        fl.action_workers("restart")
    with pytest.raises(Exception):
        docs.parse_target_list(spark.createDataFrame([("not json",)], "targets string")).collect()


def test_settings(spark):
    df = spark.createDataFrame(
        [(1, "30"), (2, "29"), (3, " 30 "), (4, "abc"), (5, ""), (6, None), (7, "3_0"), (8, "99999999999999999999")],
        "id int, raw_value string",
    )
    got = {r["id"]: (r["value"], r["reason"]) for r in fl.validate_setting(df).collect()}
    assert got[1] == (30, "ok") and got[2] == (29, "below_minimum") and got[3] == (None, "not_integer")
    assert got[4][1] == "not_integer" and got[5][1] == "missing" and got[6][1] == "missing"
    assert got[7][1] == "not_integer" and got[8][1] == "not_integer"
    assert fl.validate_seconds("45") == 45
    for bad in ("29", " 30", "x", None):
        with pytest.raises(ValueError):
            fl.validate_seconds(bad)
    ds = fl.desired_setting(spark.createDataFrame([("app1",)], "app string"), 60).collect()[0]
    assert ds["payload"] == '{"cooldownPeriodSeconds":60}'


def test_missing_fields(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, "  "), (3, "", "x")], "id int, f1 string, f2 string")
    got = {r["id"]: r["missing"] for r in qa.missing_fields(df, ["f1", "f2"]).collect()}
    assert got == {2: "f1, f2", 3: "f1"}


def test_probe_classification(spark):
    bodies = [
        (200, None, '{"other": 1}'),  # missing res_jobs
        (200, None, '{"res_jobs": []}'),
        (200, None, '{"res_jobs": [{"error": null}]}'),
        (200, None, '{"res_jobs": [{"error": ""}]}'),
        (200, None, '{"res_jobs": [{"error": "x"}]}'),
        (200, None, "not json"),
        (503, None, None),
        (None, "timeout", None),
    ]
    rows = [("2024-01-01 00:00:00", prov, "summarization", s, e, b) for prov in ("p0", "p1") for s, e, b in bodies]
    df = spark.createDataFrame(rows, "ts string, provider string, task string, status_code int, exception_type string, body string")
    got = {(r["provider"], i % len(bodies)): (r["ok"], r["failure_class"]) for i, r in enumerate(av.classify(df, RULES).collect())}
    a = [got[("p0", i)] for i in range(len(bodies))]
    b = [got[("p1", i)] for i in range(len(bodies))]
    assert a == [(False, "malformed_response"), (False, "malformed_response"), (True, None), (True, None),
                 (False, "error_message"), (False, "malformed_response"), (False, "http_error"), (False, "timeout")]
    assert b[4] == (True, None)  # Q21: status-only rule ignores the error text
    avail = av.availability(av.classify(df, RULES)).filter("provider = 'p0'").collect()[0]
    assert (avail["probes"], avail["failures"]) == (8, 6)


CATALOG = [
    ("p1", "content-importance", "/content_importance_ico", "m2", "text one"),
    ("p0", "summarization", "/insights_ico", "m1", "text two"),
    ("p0", "never-probed", "/insights_ico", "m1", "text three"),
]


def test_probe_requests_come_from_the_catalogue(spark):
    reqs = {r["task"]: r for r in av.probe_requests(spark.createDataFrame(CATALOG, av.CATALOG_SCHEMA)).collect()}
    ci = json.loads(reqs["content-importance"]["body"])["req_jobs"][0]
    assert ci["thread_depth"] == 2 and ci["id"] == 1 and ci["task"] == "content-importance" and len(ci) == 4 + 9
    assert reqs["content-importance"]["endpoint"] == "/content_importance_ico"
    plain = json.loads(reqs["summarization"]["body"])["req_jobs"][0]
    assert plain == {"id": 1, "input_text": "text two", "model": "m1", "task": "summarization"}
    assert set(reqs) == {"content-importance", "summarization", "never-probed"}


def test_probe_coverage_shows_tasks_without_probes(spark):
    probes = [("2024-01-01 00:00:00", "p0", "summarization", 500, None, None), ("2024-01-02 00:00:00", "p1", "other", 200, None, "{}")]
    df = spark.createDataFrame(probes, "ts string, provider string, task string, status_code int, exception_type string, body string")
    out = av.probe_coverage(spark.createDataFrame(CATALOG, av.CATALOG_SCHEMA), av.classify(df))
    got = {(r["provider"], r["task"]): (r["in_catalog"], r["probes"], r["failures"], r["last_probe"]) for r in out.collect()}
    assert got == {
        ("p0", "summarization"): (True, 1, 1, "2024-01-01 00:00:00"),
        ("p0", "never-probed"): (True, 0, 0, None),
        ("p1", "content-importance"): (True, 0, 0, None),
        ("p1", "other"): (False, 1, 1, "2024-01-02 00:00:00"),
    }


COST_BODIES = [
    ("a", '{"costs": {"2024-01-01": {"total_cost_cents": 150}, "2024-01-02": {"total_cost_cents": 0.5}}}'),
    ("b", None),  # the call failed
    ("c", '{"costs": {"2024-01-01": {"total_'),  # cut off
    ("d", "{}"),
    ("e", '{"costs": {}}'),
    ("f", '{"costs": 7}'),
    ("g", "not json"),
    ("h", ""),
    ("i", '{"costs": {"2024-01-01": {}}}'),
]


def test_cost_documents_that_hold_nothing_are_kept(spark):
    rows = spark.createDataFrame([(a, "prj", b) for a, b in COST_BODIES], "app string, project string, body string")
    parsed = docs.cost_documents(rows)
    got = {r["app"]: (r["status"], r["corrupt"]) for r in parsed.collect()}
    bodies = dict(COST_BODIES)
    assert {a: s for a, (s, _) in got.items()} == {
        "a": "ok", "b": "failed", "c": "malformed", "d": "empty", "e": "empty", "f": "malformed", "g": "malformed",
        "h": "malformed", "i": "ok",
    }
    assert all((c == bodies[a]) if s == "malformed" else c is None for a, (s, c) in got.items())
    costs = docs.load_app_costs(rows)
    assert {(r["app"], r["day"], r["cents"]) for r in costs.collect()} == {
        ("a", "2024-01-01", Decimal("150.0000000000")), ("a", "2024-01-02", Decimal("0.5000000000")), ("i", "2024-01-01", None),
    }
    # Every configured app without a cost that day is missing, with or without documents.
    apps = spark.createDataFrame([(a,) for a in "abcdefghi"] + [("z",), ("z",)], "app string")
    missing = sp.missing_cost_days(apps, costs, "2024-01-01", "2024-01-02").collect()
    assert {(r["app"], r["day"]) for r in missing} == {
        (a, d) for a in "bcdefghz" for d in ("2024-01-01", "2024-01-02")
    } | {("i", "2024-01-02")}
    assert len(missing) == 17
    problems = {(r["app"], r["status"], r["documents"], r["example"]) for r in docs.document_problems(parsed, "app").collect()}
    assert ("c", "malformed", 1, bodies["c"]) in problems and ("b", "failed", 1, None) in problems and len(problems) == 7


def test_requested_actions_and_their_rejects(spark, tmp_path):
    from datetime import datetime

    t = [datetime(2024, 1, 1, h) for h in range(4)]
    requests = [
        ("one", "activate", t[0]), ("one", "deactivate", t[1]), ("one", "activate", t[1]), ("one", "restart", t[3]),
        ("two", "Activate", t[0]), ("two", None, t[0]), ("none", "activate", t[0]), (None, "activate", t[0]),
        ("three", "activate", t[2]), ("three", "activate", t[2]), ("three", "activate", t[1]), ("twin", "activate", None),
    ]
    df = spark.createDataFrame(requests, "name string, action string, requested_at timestamp")
    names = ["one", "two", "three", "twin", "twin"]
    ends = docs.load_endpoints(
        spark.createDataFrame(
            [("s", json.dumps({"data": {"myself": {"endpoints": [{"id": f"i{i}", "name": n, "workersMin": 5} for i, n in enumerate(names)]}}}))],
            "snapshot_id string, body string",
        )
    )
    out = fl.requested_workers(ends, df)
    accepted = sorted((r["name"], r["id"], r["workersMin"]) for r in out.filter("reject_reason is null").collect())
    assert accepted == [("one", "i0", 0), ("three", "i2", 1), ("twin", "i3", 1), ("twin", "i4", 1)]
    rejects = {(r["requested_name"], r["action"], r["requested_at"], r["reject_reason"]) for r in out.filter("reject_reason is not null").collect()}
    assert rejects == {
        ("one", "activate", t[0], "superseded"), ("one", "activate", t[1], "superseded"), ("one", "restart", t[3], "unknown_action"),
        ("two", "Activate", t[0], "unknown_action"), ("two", None, t[0], "unknown_action"), ("none", "activate", t[0], "unknown_endpoint"),
        (None, "activate", t[0], "unknown_endpoint"), ("three", "activate", t[1], "superseded"),
    }
    path = str(tmp_path / "requests")
    assert fl.write_requests(out, path) == {"accepted": 4, "rejected": 8}
    assert spark.read.parquet(f"{path}/rejected=true").count() == 8
    assert spark.read.parquet(f"{path}/rejected=false").filter("workersMin is null").count() == 0
    assert fl.write_requests(out.limit(0), str(tmp_path / "none")) == {"accepted": 0, "rejected": 0}


def test_latch_reset_and_alert_dedup(spark):
    from datetime import datetime

    polls = [
        ("p", datetime(2024, 1, 1, 10), "d1", Decimal("250.00"), True),
        ("p", datetime(2024, 1, 1, 11), "d1", Decimal("260.00"), False),
        ("p", datetime(2024, 1, 2, 10), "d2", Decimal("270.00"), False),
        ("p", datetime(2024, 1, 2, 11), "d2", Decimal("280.00"), True),
    ]
    df = sp.severity(spark.createDataFrame(polls, "provider string, t timestamp, d string, total decimal(18,2), switch_ok boolean"), 100, 200)
    never = [r["activate"] for r in sp.latch(df, order="t").orderBy("t").collect()]
    daily = [r["activate"] for r in sp.latch(df, order="t", reset_by="d").orderBy("t").collect()]
    assert never == [True, False, False, False]  # Q18: no reset in the source
    assert daily == [True, False, True, True]
    latched = sp.latch(df, order="t")
    every = sp.spend_alerts(latched, 100, 200, time_col="t").filter("message LIKE '%Threshold%'").count()
    once = sp.spend_alerts(latched, 100, 200, time_col="t", dedup=True).filter("message LIKE '%Threshold%'").count()
    assert (every, once) == (4, 2)  # Q19: repeated per poll unless dedup

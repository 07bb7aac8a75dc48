"""Adapters: driver test tables -> the input schemas this package expects.

These functions only re-shape rows (FIXTURES.md §2-3). They do none of the
report or monitor work; every query runs the library code on their output.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.session import ensure_utc

# Evaluation time of the test reports (FIXTURES §2).
TEST_AS_OF = "2024-01-30T12:00:00+00:00"

# Event-name tables of the adapter (FIXTURES §2).
SIGNUP_NAMES = [
    "first_open",
    "onboarding_step1_registration_complete",
    "onboarding_step2_otp_error_or_invalid",
    "onboarding_step3_phone_verified_start",
    "onboarding_step3_phone_verified_complete",
    "onboarding_step4_notifications_granted",
    "onboarding_step5_contacts_granted",
    "onboarding_step6_microphone_granted",
    "onboarding_step7_location_granted",
    "onboarding_step7_location_complete",
    "onboarding_step7_carplay_complete",
    "onboarding_step9_all_done_complete",
]
PURCHASE_NAMES = [
    "integration_created_gmailemail",
    "integration_created_outlookemail",
    "integration_created_slack",
    "integration_created_msteams",
    "integration_created_googlecalendar",
    "integration_created_outlookcalendar",
    "integration_created_zoom",
    "paywall_shown_earlybird",
    "purchase_started_earlybird",
    "paywall_subscribed_earlybird",
    "paywall_closed_earlybird",
    "paywall_shown_upgrade",
    "paywall_subscribed_upgrade",
    "subscription_wall_triggered_ms_teams",
    "subscription_wall_triggered_ms_outlook_email",
    "subscription_wall_triggered_ms_outlook_calendar",
    "subscription_wall_triggered_slack",
]
VIEW_NAMES = [
    "receive_3p_message_slack",
    "receive_email_gmail",
    "receive_statement_flags",
    "receive_yesno_flags",
    "receive_multichoice_flags",
    "receive_location_share_flags",
    "receive_location_request_flags",
    "receive_eta_share_flags",
    "receive_eta_request_flags",
    "receive_status_share_flags",
    "receive_status_request_flags",
    "open_3p_message_slack",
    "open_email_gmail",
    "open_statement_flags",
    "open_yesno_flags",
    "open_multichoice_flags",
    "open_location_share_flags",
    "open_location_request_flags",
    "open_eta_share_flags",
    "open_eta_request_flags",
    "open_status_share_flags",
    "open_status_request_flags",
]
CLICK_NAMES = [
    "create_3p_message_slack",
    "create_email_gmail",
    "create_statement_flags",
    "create_yesno_flags",
    "create_multichoice_flags",
    "create_location_share_flags",
    "create_location_request_flags",
    "create_eta_share_flags",
    "create_eta_request_flags",
    "create_status_share_flags",
    "create_status_request_flags",
    "respond_3p_message_slack",
    "respond_email_gmail",
    "respond_statement_flags",
    "respond_yesno_flags",
    "respond_multichoice_flags",
    "respond_location_share_flags",
    "respond_location_request_flags",
    "respond_eta_share_flags",
    "respond_eta_request_flags",
    "respond_status_share_flags",
    "respond_status_request_flags",
]
SCREEN_NAMES = ["WelcomeScreen", "IntegrationsListScreen", "homescreen", None]


def sf_of(sf_dir: str) -> float:
    """Scale factor from a folder name like ``.../sf0.01`` (default 0.01)."""
    m = re.search(r"sf([0-9.]+)", sf_dir.rstrip("/").split("/")[-1])
    return float(m.group(1).rstrip(".")) if m else 0.01


def _pick(names: list, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), idx + 1)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events table with ``k`` parsed and ``ts`` as an instant."""
    ensure_utc(spark)
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw_to_typed(ev)


def raw_to_typed(ev: DataFrame) -> DataFrame:
    return ev.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("uid"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _param(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias("string_value")).alias("value"))


def typed_to_ga(src: DataFrame) -> DataFrame:
    """Re-shape typed driver events into the nested GA event schema."""
    uid, k, et = F.col("uid"), F.col("k"), F.col("event_type")
    name = (
        F.when(et == "signup", _pick(SIGNUP_NAMES, k % 12))
        .when(et == "purchase", _pick(PURCHASE_NAMES, k % 17))
        .when(et == "view", F.when(k < 50, F.lit("screen_view")).otherwise(_pick(VIEW_NAMES, k % 22)))
        .when(et == "click", _pick(CLICK_NAMES, k % 22))
        .when(et == "error", F.when(k % 2 == 0, F.lit("user_facing_error")).otherwise(F.lit("session_error")))
    )
    screen = F.array(
        _param("firebase_screen", _pick(SCREEN_NAMES, k % 4)),
        _param(
            "firebase_screen_class",
            F.when(k % 5 == 0, F.lit("IntegrationsListScreen")).otherwise(F.lit("MainActivity")),
        ),
    )
    other = F.array(_param("engagement_time_msec", F.lit(None)))
    with_name = src.withColumn("event_name", name)
    params = (
        F.when(et == "error", F.filter(other, lambda _: F.lit(False)))
        .when(F.col("event_name") == "screen_view", screen)
        .otherwise(other)
    )
    return with_name.select(
        uid.cast("string").alias("user_pseudo_id"),
        F.when(uid % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("u"), uid.cast("string"))).alias("user_id"),
        "event_name",
        F.unix_micros("ts").alias("event_timestamp"),
        F.struct(
            F.when(uid % 7 == 6, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("city_"), (uid % 7).cast("string")))
            .alias("city")
        ).alias("geo"),
        params.alias("event_params"),
        "event_id",
        F.to_date("ts").alias("event_date"),
    )


def ga_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GA-schema events built from ``events.parquet`` (FIXTURES §2)."""
    return typed_to_ga(raw_events(spark, sf_dir))


def excluded_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusion list of test users, as data: ``'u' || user_id`` for
    ``user_id % 37 = 0`` (FIXTURES §2), one column ``user_id``."""
    ev = raw_events(spark, sf_dir)
    return (
        ev.filter(F.col("uid") % 37 == 0)
        .select(F.concat(F.lit("u"), F.col("uid").cast("string")).alias("user_id"))
        .distinct()
    )


# ---------------------------------------------------------------------------
# Monitor inputs (FIXTURES §3). Each adapter only re-shapes driver rows into
# the documents / tables the monitors read.
# ---------------------------------------------------------------------------

# The eight probed tasks, in catalogue order.
PROBED_TASKS = [
    "summarization",
    "smart-reply",
    "pickup-intent",
    "email-smart-reply",
    "message-generation",
    "message-improvisation",
    "email-generation",
    "email-improvisation",
]


def _provider() -> Column:
    return F.concat(F.lit("p"), (F.col("uid") % 2).cast("string"))


def billing_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One billing-summary JSON document per (provider, UTC day) built from
    purchase events; the amount column is chosen by ``k % 5``."""
    from milepost.sources.documents import AMOUNT, BILL_FIELDS

    ev = raw_events(spark, sf_dir).filter(F.col("event_type") == "purchase")
    amount = F.col("value").cast(AMOUNT)
    daily = ev.groupBy(_provider().alias("provider"), F.to_date("ts").alias("day")).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("k") % 5 == i, amount)), F.lit(0).cast(AMOUNT)).cast(AMOUNT).alias(f)
            for i, f in enumerate(BILL_FIELDS)
        ]
    )
    record = F.struct(
        F.date_format(F.col("day").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
        *[F.col(f) for f in BILL_FIELDS],
    )
    doc = F.struct(
        F.struct(F.struct(F.struct(F.array(record).alias("summary")).alias("billing")).alias("myself")).alias("data")
    )
    return daily.select("provider", F.to_json(doc).alias("body"))


def app_cost_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cost document per (app, month): ``{"costs": {day: {total_cost_cents}}}``.

    app = 'app' || k % 6, project = 'prj' || k % 3; app3 has no entry on
    days of the month divisible by 7, so missing days exist.
    """
    from milepost.sources.documents import AMOUNT, CENTS

    ev = raw_events(spark, sf_dir).filter(F.col("event_type") == "purchase")
    app = F.concat(F.lit("app"), (F.col("k") % 6).cast("string"))
    project = F.concat(F.lit("prj"), (F.col("k") % 3).cast("string"))
    day = F.to_date("ts")
    daily = (
        ev.groupBy(app.alias("app"), project.alias("project"), day.alias("day"))
        .agg((F.sum(F.col("value").cast(AMOUNT)) * 100).cast(CENTS).alias("cents"))
        .filter(~((F.col("app") == "app3") & (F.dayofmonth("day") % 7 == 0)))
    )
    entry = F.struct(
        F.date_format("day", "yyyy-MM-dd").alias("key"), F.struct(F.col("cents").alias("total_cost_cents")).alias("value")
    )
    docs = daily.groupBy("app", "project", F.date_trunc("month", F.col("day").cast("timestamp")).alias("_m")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("costs")
    )
    good = docs.select("app", "project", F.to_json(F.struct("costs")).alias("body"))
    # Documents without costs: app4's call failed, app6's answer is cut off, app5 and app7 have none.
    k = F.col("k")
    other = F.concat(F.lit("app"), (k % 4 + 4).cast("string"))
    broken = ev.groupBy(other.alias("app"), F.concat(F.lit("prj"), (k % 4).cast("string")).alias("project")).agg(
        F.count(F.lit(1)).alias("n")
    )
    body = F.when(F.col("app") == "app6", '{"costs": {"2024-01-0').when(F.col("app") == "app5", "{}").when(F.col("app") == "app7", '{"costs": {}}')
    return good.unionByName(broken.select("app", "project", body.alias("body")))


def app_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured apps, 'app' || k % 9 of purchase events: app8 has no
    document at all."""
    ev = raw_events(spark, sf_dir).filter(F.col("event_type") == "purchase")
    return ev.select(F.concat(F.lit("app"), (F.col("k") % 9).cast("string")).alias("app")).distinct()


def _endpoint_record(c: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return c.select(
        F.col("c_nationkey").alias("snapshot_id"),
        (key / 1000).cast("long").alias("_chunk"),
        F.struct(
            F.lit("AMPERE_16").alias("gpuIds"),
            ((key % 8) + 1).cast("int").alias("gpuCount"),
            F.lit("12.1").alias("allowedCudaVersions"),
            key.cast("string").alias("id"),
            F.lit(5).alias("idleTimeout"),
            F.lit("EU-1").alias("locations"),
            F.col("c_name").alias("name"),
            F.lit(None).cast("string").alias("networkVolumeId"),
            F.lit("QUEUE_DELAY").alias("scalerType"),
            F.lit(4).alias("scalerValue"),
            F.concat(F.lit("tpl-"), (key % 4).cast("string")).alias("templateId"),
            ((key % 3) + 2).cast("int").alias("workersMax"),
            F.when(key % 5 == 4, F.lit(None)).otherwise(key % 3).cast("int").alias("workersMin"),
            F.lit(600000).cast("long").alias("executionTimeoutMs"),
        ).alias("_e"),
    )


def endpoint_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint inventory documents from ``customer``: one snapshot per
    nation, split into documents of at most 1000 endpoints. NULL fields are
    left out of the JSON, so some records lack ``workersMin``."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    recs = _endpoint_record(c).withColumn("snapshot_time", _snapshot_time())
    docs = recs.groupBy("snapshot_id", "snapshot_time", "_chunk").agg(F.collect_list("_e").alias("endpoints"))
    body = F.to_json(F.struct(F.struct(F.struct(F.col("endpoints")).alias("myself")).alias("data")))
    return docs.select("snapshot_id", "snapshot_time", body.alias("body"))


def _snapshot_time() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("snapshot_id") * 5)


def endpoint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same endpoints as rows (stream input), with the snapshot poll
    time: 2024-01-01 00:00 UTC + 5 minutes per nation key."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return endpoint_rows_from(c)


def endpoint_rows_from(c: DataFrame) -> DataFrame:
    recs = _endpoint_record(c)
    return recs.select("snapshot_id", _snapshot_time().alias("snapshot_time"), "_e.*")


def target_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target endpoint names (``c_custkey % 10 = 3``) as JSON array strings,
    at most 100 names per string."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").filter(F.col("c_custkey") % 10 == 3)
    lists = c.groupBy((F.col("c_custkey") / 1000).cast("long").alias("_chunk")).agg(F.collect_list("c_name").alias("names"))
    return lists.select(F.to_json("names").alias("targets"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, app, raw_value): raw_value by c_custkey % 6 among
    '30', '29', ' 30 ', 'abc', '', NULL."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("app"), _raw_value().alias("raw_value"))


def _raw_value() -> Column:
    return _pick(["30", "29", " 30 ", "abc", "", None], (F.col("c_custkey") % 6).cast("int"))


def required_fields_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, c_mktsegment, raw_value, c_name) with c_name blanked when
    ``c_custkey % 4 = 0``."""
    key = F.col("c_custkey")
    name = F.when(key % 4 == 0, F.lit("  ")).otherwise(F.col("c_name"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(key.alias("id"), "c_mktsegment", _raw_value().alias("raw_value"), name.alias("c_name"))


def worker_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested actions (name, action, requested_at): two for each customer,
    by c_custkey; some of unknown actions, some for names that don't exist."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    name = F.when(key % 11 == 5, F.concat(F.lit("none-"), F.col("c_name"))).otherwise(F.col("c_name"))
    first = _pick(["activate", "deactivate", "restart", "ACTIVATE", None], (key % 5).cast("int"))
    second = _pick(["deactivate", "activate", "stop"], (key % 3).cast("int"))
    start = F.lit("2024-01-30 08:00:00").cast("timestamp")
    both = F.array(
        F.struct(first.alias("action"), start.alias("requested_at")),
        F.struct(second.alias("action"), (start + F.make_interval(mins=(key % 2).cast("int"))).alias("requested_at")),
    )
    return c.select(name.alias("name"), F.explode(both).alias("r")).select("name", "r.*")


def probe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_records_from(raw_events(spark, sf_dir))


def probe_records_from(ev: DataFrame) -> DataFrame:
    """Recorded probe outcomes, one per event (FIXTURES §3): provider by
    user parity, task by ``event_id % 8``, outcome class by ``k % 10``."""
    k = F.col("k")
    cls = k % 10
    task = _pick(PROBED_TASKS, (F.col("event_id") % 8).cast("int"))
    status = F.when(cls == 0, F.lit(500)).when(cls == 1, F.lit(None)).otherwise(F.lit(200)).cast("int")
    exc = F.when(cls == 1, F.when((k / 10).cast("int") % 2 == 0, F.lit("timeout")).otherwise(F.lit("connection")))
    body = (
        F.when(cls == 2, F.lit('{"res_jobs":[{"error":"IN_QUEUE"}]}'))
        .when(cls == 3, F.lit('{"res_jobs":[]}'))
        .when(cls == 4, F.lit('{"res_jobs":[{"error":""}]}'))
        .when(cls >= 5, F.lit('{"res_jobs":[{"error":null}]}'))
    )
    return ev.select(
        "ts",
        _provider().alias("provider"),
        task.alias("task"),
        status.alias("status_code"),
        exc.cast("string").alias("exception_type"),
        body.alias("body"),
        F.col("event_id").alias("probe_id"),
    )


#: Success rules of the test providers.
PROBE_RULES = {"p0": "status_and_error", "p1": "status_only"}

# The probed tasks of each kind of service and their endpoint paths. The models are our own names.
DEFAULT_ENDPOINT = "/insights_ico"
TASK_ENDPOINTS = {
    "content-importance": "/content_importance_ico",
    "command-interpreter": "/command_interpreter_ico",
}
ROUTED_TASKS = [
    "command-interpreter",
    "content-importance",
    "summarization",
    "smart-reply",
    "message-improvisation",
    "email-improvisation",
]
SUMMARY_MODEL, OTHER_MODEL = "model-a", "model-b"
# Our own probe texts.
PROBE_TEXTS = {
    "summarization": "Yesterday the team met to plan the spring release. They agreed on three features, moved the launch by one week and asked design for new screens.",
    "smart-reply": "Hi Sam, are you free for a call later today?",
    "pickup-intent": "Could you grab bread and milk on your way home?",
    "email-smart-reply": "Dear Alex, can we move our review to Thursday morning? Best, Kim.",
    "message-generation": "write a message asking the team to bring snacks on Friday.",
    "message-improvisation": "Remind Ana about the dentist at 4.",
    "email-generation": "write an email to Lee asking for the quarterly numbers.",
    "email-improvisation": "Tell the supplier that the order will be one week late.",
    "command-interpreter": "Send Max a message that the meeting starts at noon.",
    "content-importance": "Hi Jo, the client needs the contract signed by tomorrow.",
}


def probe_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of the providers that the events name: p0 is probed with
    eight tasks at one endpoint, p1 with six, two of them at their own."""
    from milepost.operators.availability import CATALOG_SCHEMA

    rows = []
    for provider, tasks, routes in (("p0", PROBED_TASKS, {}), ("p1", ROUTED_TASKS, TASK_ENDPOINTS)):
        for t in tasks:
            model = SUMMARY_MODEL if t == "summarization" else OTHER_MODEL
            rows.append((provider, t, routes.get(t, DEFAULT_ENDPOINT), model, PROBE_TEXTS[t]))
    providers = raw_events(spark, sf_dir).select(_provider().alias("provider")).distinct()
    return spark.createDataFrame(rows, CATALOG_SCHEMA).join(providers, "provider").select("provider", "task", "endpoint", "model", "input_text")


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """Events as log files in the shared folder; returns their path. Error events
    have a traceback of ``k % 4`` more lines; each fiftieth has no real time."""
    from milepost.session import scratch_path

    ev = raw_events(spark, sf_dir)
    time = F.when(F.col("event_id") % 50 == 0, "2024-13-01 00:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    level = F.when(F.col("event_type") == "error", "CRITICAL").otherwise("INFO")
    head = F.concat_ws(" - ", time, F.lit("monitor"), level, F.concat(F.lit("event "), F.col("event_id").cast("string")))
    more = F.when(F.col("event_type") == "error", F.repeat(F.lit("\n  at line - of code"), (F.col("k") % 4).cast("int"))).otherwise("")
    path = scratch_path(spark, "log-files")
    ev.select(F.concat(head, more).alias("value")).write.mode("overwrite").text(path)
    return path


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rendered as tool log lines (one ``value`` per line): level
    CRITICAL for error events, else INFO; every tenth message contains ' - '."""
    ev = raw_events(spark, sf_dir)
    level = F.when(F.col("event_type") == "error", F.lit("CRITICAL")).otherwise(F.lit("INFO"))
    msg = F.when(
        F.col("event_id") % 10 == 0,
        F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" - "), F.col("event_type")),
    ).otherwise(F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type")))
    line = F.concat_ws(" - ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("monitor"), level, msg)
    return ev.select(line.alias("value"))

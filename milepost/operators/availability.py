"""Availability monitor: probe request documents, probe classification,
failure classes, availability per task and probe alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milepost.sources.documents import load_probes

# Success rules. 'status_and_error': HTTP 200 and an empty error field;
# 'status_only': HTTP 200 (an error text in the body is ignored).
STATUS_AND_ERROR = "status_and_error"
STATUS_ONLY = "status_only"

#: The columns of a probe catalogue: which task each provider is probed with,
#: where, by which model and with which text.
CATALOG_SCHEMA = "provider string, task string, endpoint string, model string, input_text string"
#: The task whose probes carry context fields.
WITH_CONTEXT = "content-importance"

# The nine context field names. The values are our own.
CONTENT_IMPORTANCE_EXTRAS = [
    ("subject_line_signals", "boolean", False),
    ("is_sender_a_known_contact", "boolean", True),
    ("is_attachment_present", "boolean", True),
    ("thread_depth", "int", 2),
    ("frequency_of_interaction_with_sender", "string", "weekly"),
    ("user_defined_keywords_or_phrases", "string", "signature, renewal"),
    ("is_sender_in_priority_contacts", "boolean", False),
    ("message_type_preference_list", "string", "Contracts"),
    ("language", "string", "en"),
]


def _map_lookup(mapping: dict, key: Column, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v)))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def probe_requests(catalog: DataFrame) -> DataFrame:
    """Request document per row of the catalogue (CATALOG_SCHEMA):
    ``{"req_jobs": [{id, input_text, model, task, ...}]}``; content-importance
    adds nine context fields."""
    is_ci = F.col("task") == WITH_CONTEXT
    extras = [F.when(is_ci, F.lit(v).cast(t)).alias(n) for n, t, v in CONTENT_IMPORTANCE_EXTRAS]
    job = F.struct(F.lit(1).alias("id"), F.col("input_text"), F.col("model"), F.col("task"), *extras)
    body = F.to_json(F.struct(F.array(job).alias("req_jobs")))  # NULL extras are left out
    return catalog.select("task", "provider", "endpoint", body.alias("body"))


def probe_coverage(catalog: DataFrame, classified: DataFrame) -> DataFrame:
    """Per (provider, task), catalogued or probed: whether it is in the catalogue,
    probes, failures and the last probe's time. A catalogued task that was never
    probed has 0 probes; a task that is probed but not catalogued shows, too."""
    listed = catalog.select("provider", "task").distinct().withColumn("_listed", F.lit(True))
    seen = classified.groupBy("provider", "task").agg(
        F.count(F.lit(1)).alias("probes"), F.count_if(~F.col("ok")).alias("failures"), F.max("ts").alias("last_probe")
    )
    both = listed.join(seen, ["provider", "task"], "full_outer")
    return both.select(
        "provider",
        "task",
        F.coalesce("_listed", F.lit(False)).alias("in_catalog"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("probes", "failures")],
        "last_probe",
    )


def classify(probes: DataFrame, rules: dict[str, str] = {}, default_rule: str = STATUS_AND_ERROR) -> DataFrame:
    """Per probe: ok flag, failure class and error text.

    ``rules`` names the success rule of providers that don't follow
    ``default_rule``. A 200 response must hold ``res_jobs[0]``; a missing or empty list (or a
    body that is not JSON) is a ``malformed_response`` failure. Under
    'status_and_error' a non-empty error text fails the probe. Only NULL and
    '' count as "no error". Failure classes are a closed set: timeout,
    connection, other, http_error, malformed_response, error_message; the
    exception's own text stays in ``error``.
    """
    probes = load_probes(probes)
    jobs = F.col("res_jobs")
    has_job = F.coalesce(F.size(jobs) > 0, F.lit(False))
    err = F.get(jobs, 0)["error"]
    rule = _map_lookup(rules, F.col("provider"), default_rule)
    status = F.col("status_code")
    no_error = err.isNull() | (err == "")
    raised = F.lower("exception_type")
    failure = (
        F.when(status.isNull() & (raised.contains("timeout") | raised.contains("timed out")), F.lit("timeout"))
        .when(status.isNull() & raised.contains("connect"), F.lit("connection"))
        .when(status.isNull(), F.lit("other"))
        .when(status != 200, F.lit("http_error"))
        .when(~has_job, F.lit("malformed_response"))
        .when((rule == F.lit(STATUS_AND_ERROR)) & ~no_error, F.lit("error_message"))
    )
    error_text = (
        F.when(status.isNull(), F.coalesce(F.col("exception_type"), F.lit("other")))
        .when(status != 200, F.concat(F.lit("HTTP "), status.cast("string")))
        .when(~has_job, F.lit("malformed_response"))
        .when((rule == F.lit(STATUS_AND_ERROR)) & ~no_error, err)
    )
    return probes.select(
        "ts",
        "provider",
        "task",
        failure.isNull().alias("ok"),
        failure.alias("failure_class"),
        error_text.alias("error"),
    )


def failure_classes(classified: DataFrame) -> DataFrame:
    """Failures per (task, failure class)."""
    return (
        classified.filter(~F.col("ok"))
        .groupBy("task", "failure_class")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def availability(classified: DataFrame) -> DataFrame:
    """Probes and failures per (provider, task) with an alert text when any
    probe failed."""
    agg = classified.groupBy("provider", "task").agg(
        F.count(F.lit(1)).alias("probes"), F.count_if(~F.col("ok")).alias("failures")
    )
    msg = F.when(
        F.col("failures") > 0,
        F.format_string("%s is not working: %d of %d probes failed", F.col("task"), F.col("failures"), F.col("probes")),
    )
    return agg.withColumn("message", msg)


def probe_alerts(classified: DataFrame) -> DataFrame:
    """One alert row per failed probe (the source alerts on every failure)."""
    return classified.filter(~F.col("ok")).select(
        F.col("ts").alias("alert_time"),
        F.concat_ws(":", F.lit("probe"), F.col("provider"), F.col("task")).alias("source"),
        F.lit("critical").alias("severity"),
        F.format_string("%s is not working: %s", F.col("task"), F.col("error")).alias("message"),
    )



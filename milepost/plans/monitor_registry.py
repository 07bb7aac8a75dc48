"""Registered monitor queries (spend, fleet, availability, quality, alerts)
at the test parameters of FIXTURES.md §4."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.functions.timefmt import parse_as_of
from milepost.operators import alerts as al
from milepost.operators import availability as av
from milepost.operators import fleet as fl
from milepost.operators import quality as qa
from milepost.operators import spend as sp
from milepost.sources import documents as docs
from milepost.sources import logs as lg
from milepost.sources import testdata as td

# Fixed test parameters (FIXTURES §4), given at sf0.01 and scaled by sf/0.01.
SOFT_AT_001 = 1700
HARD_AT_001 = 2000
WORKER_LIMIT_AT_001 = 50
COOLDOWN_SECONDS = 60
REQUIRED = ["c_mktsegment", "raw_value", "c_name"]


def scale(sf_dir: str) -> float:
    return round(td.sf_of(sf_dir) / 0.01, 6)


def limits(sf_dir: str) -> tuple[float, float]:
    s = scale(sf_dir)
    return SOFT_AT_001 * s, HARD_AT_001 * s


def bills(spark, sf_dir) -> DataFrame:
    return docs.load_billing(td.billing_docs(spark, sf_dir))


def costs(spark, sf_dir) -> DataFrame:
    return docs.load_app_costs(td.app_cost_docs(spark, sf_dir))


def daily_severity(spark, sf_dir) -> DataFrame:
    soft, hard = limits(sf_dir)
    totals = sp.bill_total(bills(spark, sf_dir)).select("provider", F.to_date("time").alias("day"), "total")
    return sp.severity(totals, soft, hard)


def with_switch_outcome(sev: DataFrame) -> DataFrame:
    """Recorded outcome of the switch call (FIXTURES §4: it succeeds on a
    hard day with an even day of month)."""
    return sev.withColumn("switch_ok", (F.col("severity") == "hard") & (F.dayofmonth("day") % 2 == 0))


def latched(spark, sf_dir) -> DataFrame:
    return sp.latch(with_switch_outcome(daily_severity(spark, sf_dir)))


def endpoints(spark, sf_dir) -> DataFrame:
    return docs.load_endpoints(td.endpoint_docs(spark, sf_dir), keep=("snapshot_id", "snapshot_time"))


def classified(spark, sf_dir) -> DataFrame:
    return av.classify(td.probe_records(spark, sf_dir), td.PROBE_RULES)


def report_days() -> list[str]:
    """The thirty days up to the evaluation time."""
    last = parse_as_of(td.TEST_AS_OF).date()
    return [(last - timedelta(days=d)).isoformat() for d in range(29, -1, -1)]


def q_missing_cost_days(spark, sf_dir):
    days = report_days()
    return sp.missing_cost_days(td.app_list(spark, sf_dir), costs(spark, sf_dir), days[0], days[-1])


def q_cost_document_problems(spark, sf_dir):
    return docs.document_problems(docs.cost_documents(td.app_cost_docs(spark, sf_dir)), "app")


def q_spend_on_days(spark, sf_dir):
    """Spend on chosen days: one of them lies after all documents."""
    return sp.spend_on(costs(spark, sf_dir), [*report_days()[::7], "2024-06-01"])


def q_requested_workers(spark, sf_dir):
    return fl.requested_workers(endpoints(spark, sf_dir), td.worker_requests(spark, sf_dir))


def q_probe_coverage(spark, sf_dir):
    return av.probe_coverage(td.probe_catalog(spark, sf_dir), classified(spark, sf_dir))


def q_log_records(spark, sf_dir):
    """Log files with tracebacks, read in splits."""
    return lg.level_counts(lg.scan_records(spark, td.log_files(spark, sf_dir)))


def q_spend_by_project(spark, sf_dir):
    c = costs(spark, sf_dir)
    return sp.spend_by_project(c.select("app", "day", "cents"), c.select("app", "project"))


def q_spend_alerts(spark, sf_dir):
    soft, hard = limits(sf_dir)
    return sp.spend_alerts(latched(spark, sf_dir), soft, hard)


def q_worker_threshold(spark, sf_dir):
    return fl.worker_alerts(fl.worker_totals(endpoints(spark, sf_dir)), int(WORKER_LIMIT_AT_001 * scale(sf_dir)))


def q_desired_workers(spark, sf_dir):
    names = docs.parse_target_list(td.target_docs(spark, sf_dir))
    return fl.desired_workers(endpoints(spark, sf_dir), names, "activate")


def q_log_levels_daily(spark, sf_dir):
    logs = docs.parse_logs(td.log_lines(spark, sf_dir))
    return logs.groupBy(F.to_date("ts").alias("day"), "level").agg(F.count(F.lit(1)).alias("n"))


def q_alerts_union(spark, sf_dir):
    soft, hard = limits(sf_dir)
    spend = sp.spend_alerts(latched(spark, sf_dir), soft, hard)
    workers = al.worker_alert_rows(q_worker_threshold(spark, sf_dir))
    probes = av.probe_alerts(classified(spark, sf_dir))
    return al.alerts_table(spend, workers, probes)


MONITOR_QUERIES = {
    "billing_flatten": bills,
    "latest_bill": lambda spark, d: sp.latest_bill(
        docs.load_billing(td.billing_docs(spark, d), position="pos"), tiebreak="pos"
    ).drop("pos"),
    "bill_total": lambda spark, d: sp.bill_total(bills(spark, d)),
    "app_costs_flatten": costs,
    "app_spend_total": lambda spark, d: sp.spend_on(costs(spark, d)),
    "missing_cost_days": q_missing_cost_days,
    "cost_document_problems": q_cost_document_problems,
    "spend_on_days": q_spend_on_days,
    "spend_by_project": q_spend_by_project,
    "spend_severity": daily_severity,
    "spend_latch": lambda spark, d: latched(spark, d).select("provider", "day", "severity", "activate"),
    "spend_alerts": q_spend_alerts,
    "endpoints_flatten": endpoints,
    "worker_totals": lambda spark, d: fl.worker_totals(endpoints(spark, d)),
    "worker_threshold": q_worker_threshold,
    "desired_workers": q_desired_workers,
    "requested_workers": q_requested_workers,
    "desired_setting": lambda spark, d: fl.desired_setting(td.settings(spark, d).select("app"), COOLDOWN_SECONDS),
    "validate_setting": lambda spark, d: fl.validate_setting(td.settings(spark, d)),
    "missing_fields": lambda spark, d: qa.missing_fields(td.required_fields_input(spark, d), REQUIRED),
    "probe_requests": lambda spark, d: av.probe_requests(td.probe_catalog(spark, d)),
    "probe_coverage": q_probe_coverage,
    "probe_classify": classified,
    "probe_failure_classes": lambda spark, d: av.failure_classes(classified(spark, d)),
    "availability_by_task": lambda spark, d: av.availability(classified(spark, d)),
    "log_levels_daily": q_log_levels_daily,
    "log_records": q_log_records,
    "alerts_union": q_alerts_union,
}

"""DuckDB oracles for the monitor queries (test parameters at sf0.01)."""

from __future__ import annotations

from milepost.operators import availability as av
from milepost.sources import testdata as td
from milepost.plans.oracle_sql import GA, _list

SOFT, HARD, WORKER_LIMIT = 1700, 2000, 50
AMOUNTS = ["gpuCloudAmount", "cpuCloudAmount", "endpointAmount", "serverlessAmount", "storageAmount"]


def w(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([GA, *ctes]) + "\n" + body


BILLS = "bills AS (\n  SELECT 'p' || CAST(uid % 2 AS VARCHAR) AS provider, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS time,\n" + ",\n".join(
    f"    CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE k % 5 = {i}), 0) AS DECIMAL(28,10)) AS {a}"
    for i, a in enumerate(AMOUNTS)
) + ",\n    CAST(0 AS DECIMAL(28,10)) AS otherAmount\n  FROM src WHERE event_type = 'purchase' GROUP BY 1, 2)"
TOTALS = "tot AS (SELECT provider, time, CAST(" + " + ".join(AMOUNTS) + " AS DECIMAL(18,2)) AS total FROM bills)"
SEV = f"""sev AS (SELECT provider, CAST(time AS DATE) AS day, total,
  CASE WHEN total > {HARD} THEN 'hard' WHEN total > {SOFT} THEN 'soft' ELSE 'none' END AS severity FROM tot)"""
LATCHED = """latched AS (SELECT provider, day, total, severity,
  severity = 'hard' AND day(day) % 2 = 0 AS switch_ok,
  severity = 'hard' AND NOT coalesce(bool_or(severity = 'hard' AND day(day) % 2 = 0) OVER (
      PARTITION BY provider ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS activate
  FROM sev)"""
COSTS = """costs AS (
  SELECT * FROM (
    SELECT 'app' || CAST(k % 6 AS VARCHAR) AS app, 'prj' || CAST(k % 3 AS VARCHAR) AS project,
           CAST(ts AS DATE) AS d, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day,
           CAST(sum(CAST(value AS DECIMAL(18,2))) * 100 AS DECIMAL(28,10)) AS cents
    FROM src WHERE event_type = 'purchase' GROUP BY 1, 2, 3, 4)
  WHERE NOT (app = 'app3' AND day(d) % 7 = 0))"""
DOLLARS = "CAST(CAST(round(cents, 0) AS DECIMAL(20,0)) * 0.01 AS DECIMAL(18,2))"
ENDPOINTS = """ep AS (
  SELECT c_nationkey AS snapshot_id, TIMESTAMP '2024-01-01 00:00:00' + c_nationkey * INTERVAL 5 MINUTE AS snapshot_time,
    'AMPERE_16' AS gpuIds, CAST(c_custkey % 8 + 1 AS INTEGER) AS gpuCount, '12.1' AS allowedCudaVersions,
    CAST(c_custkey AS VARCHAR) AS id, 5 AS idleTimeout, 'EU-1' AS locations, c_name AS name,
    NULL::VARCHAR AS networkVolumeId, 'QUEUE_DELAY' AS scalerType, 4 AS scalerValue,
    'tpl-' || CAST(c_custkey % 4 AS VARCHAR) AS templateId, CAST(c_custkey % 3 + 2 AS INTEGER) AS workersMax,
    CAST(CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE c_custkey % 3 END AS INTEGER) AS workersMin,
    CAST(600000 AS BIGINT) AS executionTimeoutMs, c_custkey
  FROM customer)"""
WTOT = """wt AS (SELECT snapshot_id, snapshot_time, count(*) AS endpoints, CAST(sum(coalesce(workersMin, 0)) AS BIGINT) AS workers
  FROM ep GROUP BY snapshot_id, snapshot_time)"""
WALERT = f"""wa AS (SELECT snapshot_id, snapshot_time, workers, endpoints,
  ' Active worker count is: `' || workers || '` which more than the threshold configured i.e. `{WORKER_LIMIT}`. Total number of endpoints: `' || endpoints || '`' AS message
  FROM wt WHERE workers > {WORKER_LIMIT})"""
SETTINGS = f"""st AS (SELECT c_custkey AS id, c_name AS app, c_mktsegment, c_name,
  {_list(["30", "29", " 30 ", "abc", "", None])}[c_custkey % 6 + 1] AS raw_value FROM customer)"""
PROBES = f"""probes AS (
  SELECT CAST(ts AS TIMESTAMP) AS ts, 'p' || CAST(uid % 2 AS VARCHAR) AS provider,
    {_list(td.PROBED_TASKS)}[event_id % 8 + 1] AS task,
    CASE WHEN k % 10 = 0 THEN 500 WHEN k % 10 = 1 THEN NULL ELSE 200 END AS status_code,
    CASE WHEN k % 10 = 1 THEN CASE WHEN (k // 10) % 2 = 0 THEN 'timeout' ELSE 'connection' END END AS exception_type,
    CASE WHEN k % 10 = 2 THEN '{{"res_jobs":[{{"error":"IN_QUEUE"}}]}}'
         WHEN k % 10 = 3 THEN '{{"res_jobs":[]}}'
         WHEN k % 10 = 4 THEN '{{"res_jobs":[{{"error":""}}]}}'
         WHEN k % 10 >= 5 THEN '{{"res_jobs":[{{"error":null}}]}}' END AS body
  FROM src)"""
CLS = """cls AS (
  SELECT ts, provider, task, failure_class IS NULL AS ok, failure_class, error FROM (
    SELECT *,
      CASE WHEN status_code IS NULL THEN coalesce(exception_type, 'other')
           WHEN status_code <> 200 THEN 'http_error'
           WHEN coalesce(njobs, 0) = 0 THEN 'malformed_response'
           WHEN rule = 'status_and_error' AND NOT (err IS NULL OR err = '') THEN 'error_message' END AS failure_class,
      CASE WHEN status_code IS NULL THEN coalesce(exception_type, 'other')
           WHEN status_code <> 200 THEN 'HTTP ' || CAST(status_code AS VARCHAR)
           WHEN coalesce(njobs, 0) = 0 THEN 'malformed_response'
           WHEN rule = 'status_and_error' AND NOT (err IS NULL OR err = '') THEN err END AS error
    FROM (SELECT *, json_array_length(body, '$.res_jobs') AS njobs,
                 json_extract_string(body, '$.res_jobs[0].error') AS err,
                 CASE provider WHEN 'p0' THEN 'status_and_error' WHEN 'p1' THEN 'status_only' ELSE 'status_and_error' END AS rule
          FROM probes)))"""
LOG_RE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) - (.*?) - ([A-Z]+) - (.*)$"
LINES = """lines AS (
  SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' - monitor - ' ||
         CASE WHEN event_type = 'error' THEN 'CRITICAL' ELSE 'INFO' END || ' - ' ||
         CASE WHEN event_id % 10 = 0 THEN 'event ' || CAST(event_id AS VARCHAR) || ' - ' || event_type
              ELSE 'event ' || CAST(event_id AS VARCHAR) || ' ' || event_type END AS value
  FROM src)"""

SPEND_ALERTS = f"""SELECT CAST(day AS TIMESTAMP) AS alert_time, 'spend:' || provider AS source, severity,
  CASE WHEN severity = 'hard'
       THEN '`URGENT: CODE RED` Hard Threshold for a single day spent reached. Amount spent: ' || CAST(total AS VARCHAR) || '. Hard Threshod limit is: {float(HARD)}'
       ELSE '`ALERT`: Soft threshold reached. Current Amount spent: `$' || CAST(total AS VARCHAR) || '`. Soft threshold is set to: `${float(SOFT)}`' END AS message
FROM latched WHERE severity <> 'none'
UNION ALL
SELECT CAST(day AS TIMESTAMP), 'spend:' || provider, 'hard',
  CASE WHEN switch_ok THEN 'Kill switch activated for ' || provider || '.'
       ELSE 'UNABLE to ACTIVATE kill switch for ' || provider || '.' END
FROM latched WHERE activate"""


def _catalog_values() -> str:
    own = {"content-importance": "/content_importance_ico", "command-interpreter": "/command_interpreter_ico"}
    shared = ["summarization", "smart-reply", "message-improvisation", "email-improvisation"]
    tasks = [("p0", t, "/insights_ico") for t in [*shared, "pickup-intent", "email-smart-reply", "message-generation", "email-generation"]]
    tasks += [("p1", t, own.get(t, "/insights_ico")) for t in [*shared, *own]]
    rows = ", ".join(
        f"('{p}', '{t}', '{e}', '{'model-a' if t == 'summarization' else 'model-b'}', '{td.PROBE_TEXTS[t]}')"
        for p, t, e in tasks
    )
    return f"cat(provider, task, endpoint, model, input_text) AS (VALUES {rows})"


def _request_json() -> str:
    base = "'id': 1, 'input_text': input_text, 'model': model, 'task': task"
    extras = ", ".join(
        f"'{n}': {('true' if v else 'false') if t == 'boolean' else (repr(v) if t == 'string' else v)}"
        for n, t, v in av.CONTENT_IMPORTANCE_EXTRAS
    )
    return (
        f"CASE WHEN task = 'content-importance' THEN to_json({{'req_jobs': [{{{base}, {extras}}}]}})"
        f" ELSE to_json({{'req_jobs': [{{{base}}}]}}) END"
    )


def monitor_oracles() -> dict[str, str]:
    q = {}
    q["billing_flatten"] = w("SELECT * FROM bills", BILLS)
    q["latest_bill"] = w("SELECT * FROM bills QUALIFY row_number() OVER (PARTITION BY provider ORDER BY time DESC) = 1", BILLS)
    q["bill_total"] = w("SELECT * FROM tot", BILLS, TOTALS)
    q["app_costs_flatten"] = w("SELECT app, project, day, cents FROM costs", COSTS)
    q["app_spend_total"] = w(f"SELECT day, CAST(sum({DOLLARS}) AS DECIMAL(18,2)) AS total FROM costs GROUP BY day", COSTS)
    q["missing_cost_days"] = w(
        """SELECT a.app, strftime(r.d, '%Y-%m-%d') AS day
FROM (SELECT DISTINCT 'app' || CAST(k % 9 AS VARCHAR) AS app FROM src WHERE event_type = 'purchase') a, range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) r(d)
WHERE NOT EXISTS (SELECT 1 FROM costs c WHERE c.app = a.app AND c.day = strftime(r.d, '%Y-%m-%d'))""",
        COSTS,
    )
    q["cost_document_problems"] = w(
        """SELECT app, CASE app WHEN 'app4' THEN 'failed' WHEN 'app6' THEN 'malformed' ELSE 'empty' END AS status,
  count(*) AS documents, CASE app WHEN 'app6' THEN '{"costs": {"2024-01-0' END AS example
FROM (SELECT DISTINCT 'app' || CAST(k % 4 + 4 AS VARCHAR) AS app, k % 4 AS project FROM src WHERE event_type = 'purchase')
GROUP BY app"""
    )
    q["spend_on_days"] = w(
        f"""SELECT d.day, CAST(coalesce(sum({DOLLARS}), 0) AS DECIMAL(18,2)) AS total
FROM (SELECT strftime(DATE '2024-01-01' + CAST(7 * i AS INTEGER), '%Y-%m-%d') AS day FROM range(5) r(i)
      UNION ALL SELECT '2024-06-01') d
LEFT JOIN costs ON costs.day = d.day GROUP BY d.day""",
        COSTS,
    )
    q["spend_by_project"] = w(
        f"SELECT project, day, CAST(sum({DOLLARS}) AS DECIMAL(18,2)) AS total FROM costs GROUP BY project, day", COSTS
    )
    q["spend_severity"] = w("SELECT * FROM sev", BILLS, TOTALS, SEV)
    q["spend_latch"] = w("SELECT provider, day, severity, activate FROM latched", BILLS, TOTALS, SEV, LATCHED)
    q["spend_alerts"] = w(SPEND_ALERTS, BILLS, TOTALS, SEV, LATCHED)
    q["endpoints_flatten"] = w("SELECT * EXCLUDE (c_custkey) FROM ep", ENDPOINTS)
    q["worker_totals"] = w("SELECT * FROM wt", ENDPOINTS, WTOT)
    q["worker_threshold"] = w("SELECT * FROM wa", ENDPOINTS, WTOT, WALERT)
    q["desired_workers"] = w(
        """SELECT gpuIds, gpuCount, allowedCudaVersions, id, idleTimeout, locations, name, networkVolumeId,
  scalerType, scalerValue, workersMax, 1 AS workersMin, executionTimeoutMs
FROM ep WHERE name IN (SELECT c_name FROM customer WHERE c_custkey % 10 = 3)""",
        ENDPOINTS,
    )
    inputs = ", ".join(
        "CASE WHEN reject_reason IS NULL THEN CAST(workers AS INTEGER) END AS workersMin" if f == "workersMin" else f"ep.{f}"
        for f in (
            "gpuIds", "gpuCount", "allowedCudaVersions", "id", "idleTimeout", "locations", "name", "networkVolumeId",
            "scalerType", "scalerValue", "workersMax", "workersMin", "executionTimeoutMs",
        )
    )
    q["requested_workers"] = w(
        f"""SELECT requested_name, action, requested_at, reject_reason, {inputs}
FROM judged LEFT JOIN ep ON judged.requested_name = ep.name AND reject_reason IS NULL""",
        ENDPOINTS,
        """asked AS (
  SELECT CASE WHEN c_custkey % 11 = 5 THEN 'none-' || c_name ELSE c_name END AS requested_name,
    ['activate', 'deactivate', 'restart', 'ACTIVATE', NULL][c_custkey % 5 + 1] AS action,
    TIMESTAMP '2024-01-30 08:00:00' AS requested_at FROM customer
  UNION
  SELECT CASE WHEN c_custkey % 11 = 5 THEN 'none-' || c_name ELSE c_name END,
    ['deactivate', 'activate', 'stop'][c_custkey % 3 + 1],
    TIMESTAMP '2024-01-30 08:00:00' + (c_custkey % 2) * INTERVAL 1 MINUTE FROM customer)""",
        """judged AS (
  SELECT *, CASE WHEN workers IS NULL THEN 'unknown_action' WHEN NOT is_endpoint THEN 'unknown_endpoint'
    WHEN row_number() OVER (PARTITION BY requested_name, workers IS NOT NULL AND is_endpoint
                            ORDER BY requested_at DESC, workers) > 1 THEN 'superseded' END AS reject_reason
  FROM (SELECT *, CASE action WHEN 'activate' THEN 1 WHEN 'deactivate' THEN 0 END AS workers,
               requested_name IN (SELECT name FROM ep) AS is_endpoint FROM asked))""",
    )
    q["desired_setting"] = w(
        """SELECT app, 60 AS cooldown_seconds, '{"cooldownPeriodSeconds":60}' AS payload FROM st""", SETTINGS
    )
    q["validate_setting"] = w(
        """SELECT id,
  CASE WHEN regexp_full_match(raw_value, '[0-9]+') THEN TRY_CAST(raw_value AS BIGINT) END AS value,
  CASE WHEN raw_value IS NULL OR raw_value = '' THEN 'missing'
       WHEN NOT regexp_full_match(raw_value, '[0-9]+') THEN 'not_integer'
       WHEN CAST(raw_value AS BIGINT) < 30 THEN 'below_minimum' ELSE 'ok' END AS reason
FROM st""",
        SETTINGS,
    )
    q["missing_fields"] = w(
        """SELECT id, missing FROM (
  SELECT id, concat_ws(', ',
    CASE WHEN c_mktsegment IS NULL OR trim(c_mktsegment) = '' THEN 'c_mktsegment' END,
    CASE WHEN raw_value IS NULL OR trim(raw_value) = '' THEN 'raw_value' END,
    CASE WHEN id % 4 = 0 OR c_name IS NULL OR trim(c_name) = '' THEN 'c_name' END) AS missing
  FROM st) WHERE missing <> ''""",
        SETTINGS,
    )
    q["probe_requests"] = w(
        f"""SELECT task, provider, endpoint, {_request_json()} AS body
FROM cat WHERE provider IN (SELECT provider FROM probes)""",
        PROBES,
        _catalog_values(),
    )
    q["probe_coverage"] = w(
        """SELECT provider, task, cat.task IS NOT NULL AS in_catalog, coalesce(s.probes, 0) AS probes,
  coalesce(s.failures, 0) AS failures, s.last_probe
FROM cat FULL JOIN (SELECT provider, task, count(*) AS probes, count(*) FILTER (WHERE NOT ok) AS failures, max(ts) AS last_probe
                    FROM cls GROUP BY provider, task) s USING (provider, task)""",
        PROBES,
        CLS,
        _catalog_values(),
    )
    q["probe_classify"] = w("SELECT * FROM cls", PROBES, CLS)
    q["probe_failure_classes"] = w(
        "SELECT task, failure_class, count(*) AS n FROM cls WHERE NOT ok GROUP BY task, failure_class", PROBES, CLS
    )
    q["availability_by_task"] = w(
        """SELECT provider, task, probes, failures,
  CASE WHEN failures > 0 THEN task || ' is not working: ' || failures || ' of ' || probes || ' probes failed' END AS message
FROM (SELECT provider, task, count(*) AS probes, count(*) FILTER (WHERE NOT ok) AS failures FROM cls GROUP BY provider, task)""",
        PROBES,
        CLS,
    )
    q["log_levels_daily"] = w(
        f"""SELECT CAST(strptime(regexp_extract(value, '{LOG_RE}', 1), '%Y-%m-%d %H:%M:%S') AS DATE) AS day,
  regexp_extract(value, '{LOG_RE}', 3) AS level, count(*) AS n
FROM lines WHERE regexp_matches(value, '{LOG_RE}') GROUP BY 1, 2""",
        LINES,
    )
    q["log_records"] = w(
        """SELECT CASE WHEN status = 'record' THEN CAST(ts AS DATE) END AS day, CASE WHEN status = 'record' THEN level END AS level,
  status, count(*) AS records, CAST(sum(lines) AS BIGINT) AS lines
FROM (SELECT ts, CASE WHEN event_type = 'error' THEN 'CRITICAL' ELSE 'INFO' END AS level,
        CASE WHEN event_id % 50 = 0 THEN 'bad_time' ELSE 'record' END AS status,
        1 + CASE WHEN event_type = 'error' THEN k % 4 ELSE 0 END AS lines FROM src)
GROUP BY 1, 2, 3"""
    )
    q["alerts_union"] = w(
        f"""{SPEND_ALERTS}
UNION ALL
SELECT snapshot_time, 'workers:' || CAST(snapshot_id AS VARCHAR), 'critical', message FROM wa
UNION ALL
SELECT ts, 'probe:' || provider || ':' || task, 'critical', task || ' is not working: ' || error FROM cls WHERE NOT ok""",
        BILLS,
        TOTALS,
        SEV,
        LATCHED,
        ENDPOINTS,
        WTOT,
        WALERT,
        PROBES,
        CLS,
    )
    q["stream_daily_spend"] = q["spend_severity"]
    q["stream_latch"] = q["spend_latch"]
    q["stream_workers"] = q["worker_threshold"]
    q["stream_availability"] = w(
        """SELECT date_trunc('hour', ts) AS window_start, provider, task, count(*) AS probes,
  count(*) FILTER (WHERE NOT ok) AS failures FROM cls GROUP BY 1, 2, 3""",
        PROBES,
        CLS,
    )
    q["stream_milestones"] = stream_milestones_oracle()
    q["stream_nth_milestones"] = stream_nth_oracle()
    return q


def stream_nth_oracle() -> str:
    from milepost.plans.oracle_sql import INTERACTION, MESSAGE, NAMED, cet, with_ga

    def at(kind: str, n: int) -> str:
        return cet(f"min(event_timestamp) FILTER (WHERE kind = '{kind}' AND nth = {n})")

    return with_ga(
        f"""SELECT user_pseudo_id, {at("named", 3)} AS step5_connects_3_integrations,
  {at("message", 10)} AS step8_receives_and_opens_10th_msg_or_email,
  {at("interaction", 5)} AS step9_sends_5th_email_message_status_share
FROM (SELECT *, row_number() OVER (PARTITION BY user_pseudo_id, kind ORDER BY event_timestamp, event_id) AS nth
      FROM kinds WHERE kind IS NOT NULL)
GROUP BY user_pseudo_id""",
        f"""kinds AS (
  SELECT user_pseudo_id, event_timestamp, event_id,
    CASE WHEN regexp_full_match(event_name, '{MESSAGE}') THEN 'message'
         WHEN regexp_full_match(event_name, '{INTERACTION}') THEN 'interaction'
         WHEN regexp_full_match(event_name, '{NAMED}') THEN 'named' END AS kind
  FROM ga)""",
    )


def stream_milestones_oracle() -> str:
    from milepost.plans.oracle_sql import cet, with_ga
    from milepost.plans.stream_registry import STREAM_SPECS

    cols = []
    for m in STREAM_SPECS:
        cond = f"event_name LIKE '{m.like}'" if m.like else f"event_name = '{m.event}'"
        cols.append(f"{cet(f'min(event_timestamp) FILTER (WHERE {cond})')} AS {m.column}_first")
        cols.append(f"{cet(f'max(event_timestamp) FILTER (WHERE {cond})')} AS {m.column}_latest")
    return with_ga("SELECT user_pseudo_id, " + ", ".join(cols) + " FROM ga GROUP BY user_pseudo_id")

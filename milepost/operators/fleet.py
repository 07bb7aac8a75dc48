"""Fleet monitor and desired-state builders: worker totals, threshold
alerts, endpoint payloads, setting validation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# The worker alert text and the mutation input fields.
WORKER_TEXT = " Active worker count is: `%d` which more than the threshold configured i.e. `%d`. Total number of endpoints: `%d`"
MUTATION_FIELDS = [
    "gpuIds",
    "gpuCount",
    "allowedCudaVersions",
    "id",
    "idleTimeout",
    "locations",
    "name",
    "networkVolumeId",
    "scalerType",
    "scalerValue",
    "workersMax",
    "workersMin",
    "executionTimeoutMs",
]
ACTIONS = {"activate": 1, "deactivate": 0}
DIGITS = r"^[0-9]+$"


SNAPSHOT = ("snapshot_id", "snapshot_time")


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def worker_totals(endpoints: DataFrame, by=SNAPSHOT) -> DataFrame:
    """Endpoints and configured minimum workers per group (missing or NULL
    ``workersMin`` counts 0)."""
    return endpoints.groupBy(*_keys(by)).agg(
        F.count(F.lit(1)).alias("endpoints"),
        F.sum(F.coalesce(F.col("workersMin"), F.lit(0))).cast("long").alias("workers"),
    )


def worker_alerts(totals: DataFrame, limit: int, by=SNAPSHOT) -> DataFrame:
    """Groups whose worker total is strictly above ``limit``."""
    over = totals.filter(F.col("workers") > F.lit(limit))
    return over.select(
        *_keys(by),
        "workers",
        "endpoints",
        F.format_string(WORKER_TEXT, F.col("workers"), F.lit(int(limit)), F.col("endpoints")).alias("message"),
    )


def action_workers(action: str) -> int:
    """'activate' -> 1, 'deactivate' -> 0; anything else is rejected."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}; expected one of {sorted(ACTIONS)}")
    return ACTIONS[action]


def action_column(col: str) -> F.Column:
    """Column form of :func:`action_workers` for a table of requested
    actions: NULL for unknown values (route those to a reject table)."""
    c = F.col(col)
    return F.when(c == "activate", F.lit(1)).when(c == "deactivate", F.lit(0))


def desired_workers(endpoints: DataFrame, target_names: DataFrame, action: str) -> DataFrame:
    """Mutation inputs for every endpoint whose name is a target: the
    endpoint's fields with ``workersMin`` replaced by the action's value
    (``templateId`` is read but not sent)."""
    workers = action_workers(action)
    names = target_names.select("name").distinct()
    chosen = endpoints.join(names, "name", "left_semi")
    return chosen.select(
        *[F.lit(workers).cast("int").alias(f) if f == "workersMin" else F.col(f) for f in MUTATION_FIELDS]
    )


# Why a requested action isn't carried out.
UNKNOWN_ACTION, UNKNOWN_ENDPOINT, SUPERSEDED = "unknown_action", "unknown_endpoint", "superseded"


def requested_workers(endpoints: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested actions (name, action, requested_at) -> the mutation inputs of
    accepted ones, plus ``name``-level rejects, as one table: requested_name,
    action, requested_at, reject_reason (NULL: accepted) and MUTATION_FIELDS.

    Unknown or missing actions and names that no endpoint has are rejected. Of
    several valid requests for a name the latest counts (of equal times,
    deactivating), the others are superseded. An accepted request gives a row for
    each endpoint of that name, a reject one row.
    """
    known = endpoints.select("name").distinct().select(F.col("name").alias("_known"))
    workers = action_column("action")
    asked = requests.select(F.col("name").alias("requested_name"), "action", "requested_at", workers.alias("_workers"))
    found = asked.join(known, F.col("requested_name") == F.col("_known"), "left")
    valid = F.col("_workers").isNotNull() & F.col("_known").isNotNull()
    # The latest valid request per name: a partial aggregate, so many requests
    # for one name don't meet in a task.
    order = F.struct("requested_at", (-F.col("_workers")).alias("w"))
    latest = found.filter(valid).groupBy(F.col("requested_name").alias("_name")).agg(F.max(order).alias("_last"))
    placed = found.join(latest, F.col("requested_name") == F.col("_name"), "left")
    # Equal requests (same time and action) are one.
    same = ["requested_name", "action", "requested_at"]
    reason = (
        F.when(F.col("_workers").isNull(), UNKNOWN_ACTION)
        .when(F.col("_known").isNull(), UNKNOWN_ENDPOINT)
        .when(~order.eqNullSafe(F.col("_last")), SUPERSEDED)
    )
    decided = placed.withColumn("reject_reason", reason).dropDuplicates(same)
    fields = [F.col(f).alias(f) for f in MUTATION_FIELDS if f != "workersMin"]
    chosen = endpoints.select(F.col("name").alias("_endpoint"), *fields)
    on = (F.col("requested_name") == F.col("_endpoint")) & F.col("reject_reason").isNull()
    rows = decided.join(chosen, on, "left")
    sent = F.when(F.col("reject_reason").isNull(), F.col("_workers")).cast("int")
    inputs = [sent.alias(f) if f == "workersMin" else F.col(f) for f in MUTATION_FIELDS]
    return rows.select(*same, "reject_reason", *inputs)


def write_requests(requested: DataFrame, path: str) -> dict[str, int]:
    """Write :func:`requested_workers` in one pass to two tables below ``path``,
    ``rejected=false`` (mutation inputs) and ``rejected=true``; return how many
    rows of each there are, as observed while writing."""
    counts = Observation()
    bad = F.col("reject_reason").isNotNull()
    rows = requested.withColumn("rejected", bad).observe(
        counts, F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected")
    )
    rows.write.partitionBy("rejected").parquet(path)
    # A plan that turns out to be empty is not observed.
    wrote = not requested.sparkSession.read.schema(rows.schema).parquet(path).isEmpty()
    return counts.get if wrote else {"accepted": 0, "rejected": 0}


def desired_payload(desired: DataFrame) -> DataFrame:
    """The mutation document per endpoint as JSON text."""
    doc = F.struct(F.struct(F.struct(*MUTATION_FIELDS).alias("input")).alias("variables"))
    return desired.select("id", F.to_json(doc).alias("payload"))


def validate_seconds(value) -> int:
    """Driver-side check of one setting value (digits only, >= 30)."""
    text = "" if value is None else str(value)
    if not re.fullmatch(r"[0-9]+", text):
        raise ValueError(f"invalid cool-down period {value!r}: must be an integer")
    if int(text) < 30:
        raise ValueError(f"cool-down period must be at least 30 (got {text})")
    return int(text)


def desired_setting(apps: DataFrame, seconds, app_col: str = "app") -> DataFrame:
    """One validated cool-down value applied to every app: (app,
    cooldown_seconds, payload)."""
    s = validate_seconds(seconds)
    return apps.select(
        F.col(app_col).alias("app"),
        F.lit(s).alias("cooldown_seconds"),
        F.to_json(F.struct(F.lit(s).alias("cooldownPeriodSeconds"))).alias("payload"),
    )


def validate_setting(df: DataFrame, col: str = "raw_value", id_col: str = "id", minimum: int = 30) -> DataFrame:
    """Check a column of setting values with the strict digits-only rule.

    reason: 'missing' (NULL or empty), 'not_integer' (anything but digits,
    spaces included), 'below_minimum', or 'ok'. ``value`` is the integer
    when the text is digits.
    """
    v = F.col(col)
    digits = v.rlike(DIGITS)
    value = F.when(digits, v.try_cast("long"))
    reason = (
        F.when(v.isNull() | (v == ""), F.lit("missing"))
        .when(~digits | value.isNull(), F.lit("not_integer"))
        .when(value < F.lit(minimum), F.lit("below_minimum"))
        .otherwise(F.lit("ok"))
    )
    return df.select(F.col(id_col).alias("id"), value.alias("value"), reason.alias("reason"))
